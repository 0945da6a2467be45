"""Confusable phrases: neighbouring words joined to the table, then claimed greedily within each paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.charset import recapitalise_col
from .edits import claim_phrases_col
from .tokens import KEY, parts_col


def phrase_matches(paras: DataFrame, table: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """keys, pos, n, section, phrase, before, after: the claimed matches of `table` (section, key, value, file_ix).

    Words of a phrase have only spaces between them. Always-wrong rows come first, then longer keys, then file order, then
    position; a word that is claimed is not used again. The table is small by nature and broadcast.
    """
    parts = F.col("parts")

    def gram(i, n):
        words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lower(F.get(parts, i + k * 2)))
        gaps = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda k: F.get(parts, i + k * 2 + 1)) if n > 1 else F.array().cast("array<string>")
        whole = F.array_join(F.slice(parts, i + 1, F.lit(2 * n - 1)), "")
        ok = (F.size(parts) >= i + (2 * n - 1)) & F.forall(gaps, lambda g: g.rlike("^ *$"))
        return F.when(ok, F.struct(i.alias("pos"), F.lit(n).alias("n"), F.array_join(words, " ").alias("phrase"), whole.alias("before")))

    # Grams are made only where a key's first word stands, and of the lengths that keys have.
    known = table.select("key").collect()
    lengths = sorted({len(r["key"]) for r in known})
    opening = sorted({r["key"][0] for r in known})
    rows = paras.select(*keys, parts_col(F.col("text")).alias("parts"))
    starts = F.filter(F.transform(parts, lambda p, i: F.when(F.lower(p).isin(opening), i)), lambda i: i.isNotNull())
    grams = F.flatten(F.transform(starts, lambda i: F.array(*[gram(i, n) for n in lengths])))
    rows = rows.select(*keys, F.inline(F.filter(grams, lambda g: g.isNotNull())))
    small = table.select("section", F.array_join("key", " ").alias("phrase"), F.size("key").alias("n"), "value", "file_ix")
    hits = rows.join(F.broadcast(small), ["phrase", "n"]).withColumn("after", recapitalise_col(F.col("before"), F.col("value")))
    hits = hits.filter(F.col("before") != F.col("after"))
    order = F.struct("section", (-F.col("n")).alias("shorter"), "file_ix", "pos", "n", "phrase", "before", "after")
    per_para = hits.groupBy(*keys).agg(F.collect_list(order).alias("found"))
    return per_para.select(*keys, F.inline(claim_phrases_col(F.col("found")))).select(*keys, "pos", "n", "section", "phrase", "before", "after")
