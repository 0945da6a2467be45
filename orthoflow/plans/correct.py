"""The correction plan: book statistics, rule layers, open cases, decisions, edits. One barrier, between pass 1 and pass 2."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layers
from ..functions.syllables import syllable_table
from ..operators import stats
from ..operators.decide import Scorer, with_scorer, without_scorer
from ..operators.edits import apply_edits_col
from ..operators.rank import open_cases
from ..operators.tokens import KEY, marked_tokens, paragraph_context, tokens
from ..sources.lexicon import Options, confusable_rows, typo_table
from ..staging import Scratch, small_side

_EDIT = "struct<layer:int,start:int,end:int,before:string,after:string,kind:string,certainty:string,reason:string>"
#: A row's number, given once at the start: rows that share their keys, or have none, stay apart.
ROW = "row_id"


@dataclass
class BookStats:
    """What pass 1 found, one table each."""

    style: DataFrame
    names: DataFrame
    clusters: DataFrame
    used: DataFrame


@dataclass
class Correction:
    """paragraphs: keys, text_before, text; edits: the log of applied edits; open: cases left; stats of pass 1."""

    paragraphs: DataFrame
    edits: DataFrame
    open: DataFrame
    stats: BookStats


def book_stats(paras: DataFrame, lexicon: DataFrame, compounds: DataFrame, syllables: DataFrame, scratch: Scratch) -> BookStats:
    """Pass 1: counts over the composed but otherwise raw text of whole books."""
    seen = scratch.table(stats.seen(paras, compose=True), "seen")
    found = {
        "style": stats.tone_style(seen, syllables),
        "names": stats.names(seen, lexicon),
        "clusters": stats.name_clusters(seen, lexicon, compounds),
        "used": stats.used_words(seen),
    }
    # All four in one job and one table, each with its own columns.
    tagged = [df.withColumn("what", F.lit(name)) for name, df in found.items()]
    whole = scratch.table(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged), "statistics")
    scratch.drop(seen)
    return BookStats(**{name: whole.filter(F.col("what") == name).select(df.columns) for name, df in found.items()})


def layered(paras: DataFrame, style: DataFrame, options: Options) -> DataFrame:
    """row_id, keys, text_before, text, edits, doubtful after layers 1 to 6."""
    table = confusable_rows()
    styled = paras.join(style.select("book_id", "style"), "book_id", "left")
    row_keys = [ROW, *KEY]
    keys = ", ".join(f"{k} {styled.schema[k].dataType.simpleString()}" for k in row_keys)
    schema = f"{keys}, text_before string, text string, edits array<{_EDIT}>, doubtful array<{_EDIT}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("layer", "start", "end")] + [(n, pa.string()) for n in ("before", "after", "kind", "certainty", "reason")]))
        for batch in batches:
            done = [
                layers.run_layers(t, s == "new", options, table)
                for t, s in zip(batch.column("text").to_pylist(), batch.column("style").to_pylist(), strict=True)
            ]
            logs = [[{"layer": n, **e._asdict()} for n, e in d.edits] for d in done]
            doubts = [[{"layer": 6, **e._asdict()} for e in d.open] for d in done]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in row_keys), batch.column("text"), pa.array([d.text for d in done], pa.string()), pa.array(logs, kind), pa.array(doubts, kind)],
                [*row_keys, "text_before", "text", "edits", "doubtful"],
            )

    return styled.select(*row_keys, "text", "style").mapInArrow(run, schema)


def correct(
    paras: DataFrame, lexicon: DataFrame, compounds: DataFrame, options: Options = Options(), scorer: Scorer | None = None, typos: DataFrame | None = None
) -> Correction:
    """Correct `paras` (book_id, entry_ix, para_ix, text) against `lexicon` (syllable) and `compounds` (compound).

    Null texts are left out; rows that repeat their keys, or have null keys, are paragraphs of their own. Books are counted as wholes first; then every paragraph goes through the layers, the
    remaining bad syllables become cases, and decided cases are applied.
    """
    spark = paras.sparkSession
    scratch = Scratch(spark, "correct")
    typos = typo_table(spark) if typos is None else typos
    syllables = syllable_table(spark)
    paras = scratch.table(paras.filter("text IS NOT NULL").select(F.monotonically_increasing_id().alias(ROW), *KEY, "text"), "paragraphs")
    book = book_stats(paras, lexicon, compounds, syllables, scratch)
    # A text that no layer changed is kept once.
    kept = scratch.table(layered(paras, book.style, options).withColumn("text", F.when(F.col("text") != F.col("text_before"), F.col("text"))), "layered")
    done = kept.withColumn("text", F.coalesce("text", "text_before"))
    found = None
    cases = done.select(ROW, *KEY, F.inline("doubtful")).select(
        ROW, *KEY, "start", "end", "before", F.array("after").alias("cands"), "kind", "reason", F.lit("none").alias("evidence")
    )
    if options.bad_syllables:
        toks = tokens(done, [ROW, *KEY], starts=True) if options.plain_words else marked_tokens(done, [ROW, *KEY])
        known = small_side(scratch.table(book.names, "names", F.octet_length("word") + 64))
        found = stats.suspicious(toks, lexicon, syllables, known, options.plain_words)
        found = scratch.table(found.select(ROW, *KEY, "start", "tok", "prev", "next"), "found")
        opened = open_cases(found, lexicon, compounds, book.clusters, book.used, typos, scratch)
        placed = opened.withColumn("end", F.col("start") + F.length("tok"))
        cases = cases.unionByName(placed.select(ROW, *KEY, "start", "end", F.col("tok").alias("before"), "cands", "kind", "reason", "evidence"))
    cases = scratch.table(cases, "cases")
    scratch.drop(found)
    if scorer is None:
        decided = without_scorer(cases)
    else:
        # Only the texts of the paragraphs that a scorer is asked about are dealt out.
        scored = small_side(scratch.table(cases.filter("evidence = 'none'").select(ROW).distinct(), "scored"), 16)
        asked = cases.join(done.select(ROW, "text").join(scored, ROW, "left_semi"), ROW, "left")
        if options.blank_fill:
            # Neighbours are the composed paragraphs, as pass 1 read them.
            near = paragraph_context(paras.select(ROW, *KEY, layers.compose(F.col("text")).alias("text")), [ROW])
            near = near.select(ROW, F.col("before").alias("before_text"), F.col("after").alias("after_text")).join(scored, ROW, "left_semi")
            asked = asked.join(near, ROW, "left")
        decided = with_scorer(asked, scorer, options)
    decided = scratch.table(decided, "decided")
    scratch.drop(paras, cases)
    chosen = decided.filter("decided IS NOT NULL AND decided <> before").select(
        ROW, F.struct("start", "end", F.col("decided").alias("after"), "before", "kind", "certainty", "reason").alias("e")
    )
    per_para = chosen.groupBy(ROW).agg(F.collect_list("e").alias("chosen"))
    size = 64 + F.aggregate("chosen", F.lit(0), lambda n, e: n + 64 + F.octet_length(e["after"]) + F.octet_length(e["before"]) + F.octet_length(e["reason"]))
    joined = done.join(small_side(scratch.table(per_para, "chosen", size)), ROW, "left")
    fixed = F.when(F.col("chosen").isNotNull(), apply_edits_col(F.col("text"), F.col("chosen")))
    joined = joined.select(*KEY, "text_before", "text", "edits", "chosen", fixed.alias("fixed"))
    after = F.coalesce("fixed.text", "text")
    final = joined.select(*KEY, "text_before", F.when(after != F.col("text_before"), after).alias("text"), "edits", "chosen", F.col("fixed.starts").alias("starts"))
    final = scratch.table(final, "final")
    scratch.drop(kept)
    # Of the chosen edits, in their order, those that were applied: the starts that the fold accepted.
    applied = F.filter(F.array_sort("chosen"), lambda e: F.array_contains("starts", e["start"]))
    late = final.filter("chosen IS NOT NULL").select(*KEY, F.inline(applied)).select(
        *KEY, F.lit(7).alias("layer"), "start", "end", "before", "after", "kind", "certainty", "reason"
    )
    log = final.select(*KEY, F.inline("edits")).unionByName(late)
    paragraphs = final.select(*KEY, "text_before", F.coalesce("text", "text_before").alias("text"))
    still = decided.filter("decided IS NULL") if scorer is None else decided.limit(0)
    return Correction(paragraphs, log, still.select(*KEY, *["start", "end", "before", "cands", "kind", "reason", "evidence"]), book)
