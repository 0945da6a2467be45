"""Helpers of the corpus operators; scratch tables and size-checked joins come from `orthoflow.staging`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import BROADCAST_BYTES, Scratch, rows, scratch_root, small_side, spread

__all__ = ["BROADCAST_BYTES", "LOWER", "SPACES", "Scratch", "UPPER", "ascii_lower", "keep_rows", "read", "rows", "scratch_root", "small_side", "spread", "text_or_empty", "tokenizer"]

#: `[\x20\x09-\x0D]`, the white space that the operators strip and split on.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def keep_rows(docs: DataFrame, key, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """`docs` without the rows in `gone`, and with one row of each in `repeated`; both are scratch tables (k_id, k_hash).

    `key` is the hash column of a row's text; with the doc_id it names a row. Both tables are joined by a checked broadcast, or
    by sort-merge. Repeats are dropped by an aggregate, so many rows of one key meet combined.
    """

    def at(table):
        return docs["doc_id"].eqNullSafe(table["k_id"]) & (key == table["k_hash"])

    left = docs.join(small_side(gone, 48), at(gone), "left_anti")
    if not rows(repeated):
        return left
    some = small_side(repeated, 48)
    once = left.join(some, at(repeated), "left_semi").withColumn("_row_hash", key).dropDuplicates(["doc_id", "_row_hash"]).drop("_row_hash")
    return left.join(some, at(repeated), "left_anti").unionByName(once)
