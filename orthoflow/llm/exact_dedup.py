"""Exact dedup by distributed MSD radix partitioning: no digest takes part in equality.

All documents start in one group. A round reads the next digit of every document that is still open, a run
of successive bytes, and splits each group by it. A document that is alone in its new group is done, and so
is a group whose digit was shorter than the digit's width: its texts have ended and are equal. The rest goes on.
Digits widen by `GROWTH` each round, so rounds grow with the logarithm of the longest text and
a round costs what the documents still open hold: after the first, copies and texts with a common start.

Skew: a group's size, smallest and largest doc_id come from an aggregate on (group, digit), which combines equal
digits in the map tasks, so a text with a third of all rows stays cheap. Its rows then meet the group's one row
in a join whose large side Spark can split. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, keep_rows, text_or_empty

FIRST_DIGIT, GROWTH, WIDEST = 128, 4, 1 << 18


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """Every row of `docs` as (doc_id, keep_id, group_size, kept, text_sha256).

    keep_id is the largest doc_id of the rows with the same text (null counts as empty; a null doc_id only
    where all are null) and `kept` is doc_id = keep_id. Rows that repeat both doc_id and text are one document:
    they count in group_size and share `kept`. text_sha256 is for the caller's use. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = text_or_empty()
    live = docs.select(
        "doc_id", F.lit(0).cast("bigint").alias("grp"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.cast("binary").alias("rest")
    )
    done, source, width = [], None, first_digit
    while True:
        digit = F.substring("rest", 1, width)
        cells = live.groupBy("grp", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        cells = cells.filter("n > 1").withColumn("next", F.monotonically_increasing_id())
        cells = scratch.table(cells.withColumnsRenamed({"grp": "c_grp", "digit": "c_digit"}), "cells")
        joined = live.withColumn("digit", digit).join(
            cells.hint("merge"), (F.col("grp") == F.col("c_grp")) & (F.col("digit") == F.col("c_digit")), "left"
        )
        single, ended = F.col("n").isNull(), F.length("digit") < width
        out = scratch.table(
            joined.select(
                "doc_id",
                F.col("next").alias("grp"),
                "sha",
                F.when(~single & ~ended, F.substring(F.col("rest"), F.lit(width + 1), F.lit(2**31 - 1))).alias("rest"),
                F.when(single, F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
            ),
            "round",
        )
        scratch.drop(cells, source)
        source = None
        done.append(out.filter("rest IS NULL").select("doc_id", "keep_id", "group_size", "sha"))
        live = out.filter("rest IS NOT NULL").select("doc_id", "grp", "sha", "rest")
        if live.isEmpty():
            break
        width = min(width * growth, widest)
    result = done[0]
    for d in done[1:]:
        result = result.unionAll(d)
    return result.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each text, with all its columns: the one `exact_groups` keeps; of rows that repeat its doc_id too, any one.

    Null doc_ids count as equal. See `keep_rows` for how rows are found.
    """
    scratch = Scratch(docs.sparkSession, "exact-keep")
    groups = exact_groups(docs).select(F.col("doc_id").alias("k_id"), F.unhex("text_sha256").alias("k_hash"), "kept")
    keys = scratch.table(groups.groupBy("k_id", "k_hash", "kept").agg(F.count(F.lit(1)).alias("k_rows")), "keys")
    gone = scratch.table(keys.filter("NOT kept").select("k_id", "k_hash"), "dropped")
    repeated = scratch.table(keys.filter("kept AND k_rows > 1").select("k_id", "k_hash"), "repeated")
    return keep_rows(docs, F.unhex(F.sha2(text_or_empty().cast("binary"), 256)), gone, repeated)
