"""A training-corpus pipeline over `documents`: quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next one's docs.
The first three return rows of `documents`, unchanged; the last returns packed sequences: which pieces stand in each, and
the checksum of their ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthoflow.llm import exact_dedup, minhash_dedup, packing, quality
from orthoflow.llm._shared import Scratch, read, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores at 0.3 or more; fitted on the labels that are not held out."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(*COLUMNS), model, threshold=0.3)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.keep_one(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the row with the smallest doc_id."""
    return minhash_dedup.keep_one(docs.select(*COLUMNS), words=5)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of the token ids of all documents; workers hold less than in the query, as earlier stages fill the executor's heap."""
    return packing.pack_texts(docs, tokenizer("byte_bpe_50k.json"), cache_chunks=250_000, slice_bytes=4 << 20).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("minhash near-dedup", near_copies),
    ("best-fit packing", best_fit),
]

#: SQL cannot express the fitted model or the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-")) if i < len(STAGES) - 1 else stage(spark, docs, sf_dir)
    return docs
