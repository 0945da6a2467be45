"""Files of language models and the cards that can run them, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of a model file, and the least memory of a card that is used for one.
MAGIC, LEAST_MEMORY = "GGUF", 4 << 30


def is_model(content: Column) -> Column:
    """Whether a file's bytes begin as a model's do; false for null and shorter ones."""
    return F.coalesce(F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC.encode()), F.lit(False))


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the .gguf files in `folder` and in the folders right below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gguf").option("recursiveFileLookup", "true").load(folder)
    below = F.split(F.element_at(F.split("path", F.lit(f"/{folder.rstrip('/').rpartition('/')[2]}/")), -1), "/")
    return files.filter(F.size(below) <= 2).select("path", "length")


def usable_cards(cards: DataFrame, least: int = LEAST_MEMORY) -> DataFrame:
    """Cards (.., memory) with enough memory for a model; unknown memory is too little."""
    return cards.filter(F.col("memory") >= least)


def largest_card(cards: DataFrame, by: list[str] = []) -> DataFrame:
    """The card (name, memory) with the most memory, of each group; of equals the first name; unknown memory is none."""
    known = cards.filter("name IS NOT NULL AND memory IS NOT NULL")
    best = known.groupBy(*by).agg(F.min_by("name", F.struct((-F.col("memory")).alias("less"), "name")).alias("name"), F.max("memory").alias("memory"))
    return best.filter("name IS NOT NULL")  # without cards there is no largest one
