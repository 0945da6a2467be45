"""Curation of lexicons: words of raw entries, misspelt entries, and compounds that hold one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions.charset import letter_class, strip_all


def build_lexicons(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(syllable) and (compound) of dictionary entries (text), in lower case; entries with a colon are skipped.

    An entry of several words joined by spaces is a compound, and each of its words a syllable.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({letter_class()}+)"), F.lit(1))
    rows = entries.filter(~F.contains("text", F.lit(":"))).select(words.alias("words"))
    syllables = rows.select(F.explode("words").alias("syllable")).distinct()
    compounds = rows.filter(F.size("words") > 1).select(F.array_join("words", " ").alias("compound")).distinct()
    return syllables, compounds


def misspelt(lexicon: DataFrame, syllables: DataFrame) -> DataFrame:
    """(syllable) entries without a valid structure, with a letter beyond ASCII, that a change of marks alone would mend."""
    odd = lexicon.filter(F.col("syllable").rlike("[^0-9A-Za-z]")).join(F.broadcast(syllables.select(F.col("word").alias("syllable"))), "syllable", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [w for w in batch.column(0).to_pylist() if any(strip_all(c.lower()) == strip_all(w) for c, _ in C.candidates(w))]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["syllable"])

    return odd.select("syllable").mapInArrow(run, "syllable string")


def drop_misspelt(lexicon: DataFrame, compounds: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lexicons without `bad` syllables and without the compounds that hold one."""
    held = compounds.select("compound", F.explode(F.split("compound", " ")).alias("syllable")).join(bad, "syllable", "left_semi")
    return lexicon.join(bad, "syllable", "left_anti"), compounds.join(held.select("compound"), "compound", "left_anti")


def rejected_entries(lexicon: DataFrame, syllables: DataFrame) -> DataFrame:
    """(syllable) lexicon entries that the rhyme table does not allow: loan words, mostly."""
    return lexicon.join(F.broadcast(syllables.select(F.col("word").alias("syllable"))), "syllable", "left_anti")


def trap_scores(traps: DataFrame, thresholds: list[float]) -> DataFrame:
    """(mode, threshold, n_right, n) over scored traps (mode, word, gain, first_gain, should_change, right_fix).

    A trap is right when it changes exactly if it should: the gain over the original passes the threshold, with the right fix.
    """
    limits = traps.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    each = traps.crossJoin(F.broadcast(limits))
    changes = (F.col("gain") > F.col("threshold")) & ~F.isnan("gain")
    right = F.when(F.col("should_change"), changes & F.col("right_fix")).otherwise(~changes)
    return each.groupBy("mode", "threshold").agg(F.count_if(right).alias("n_right"), F.count(F.lit(1)).alias("n"))
