"""Readers of lexicons and correction tables, from text files or the built-in fixed tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import CONFUSABLES, TYPOS
from ..staging import local_table


def read_words(spark: SparkSession, path: str, column: str = "syllable") -> DataFrame:
    """Distinct non-empty lines of a text file."""
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias(column)).distinct()


def write_words(words: DataFrame, path: str) -> None:
    """Distinct words in order, one per line; fails if `path` exists."""
    c = words.columns[0]
    words.filter(F.col(c).isNotNull()).select(c).distinct().orderBy(c).write.text(path)


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """The `text` field of a file with one JSON object per line."""
    return spark.read.text(path).select(F.get_json_object("value", "$.text").alias("text")).filter("text IS NOT NULL")


def typo_rows(text: str = TYPOS) -> list[tuple[str, list[str]]]:
    """(typo, answers) of `typo => answer | answer` lines; `#` comments; of a repeated typo the last line stands."""
    found = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=>" in line:
            left, right = line.split("=>", 1)
            answers = [a.strip() for a in right.split("|") if a.strip()]
            if left.strip() and answers:
                found[left.strip().lower()] = answers
    return list(found.items())


def typo_table(spark: SparkSession, text: str = TYPOS) -> DataFrame:
    return local_table(spark, typo_rows(text), "typo string, answers array<string>")


def typo_lines(lines: DataFrame) -> DataFrame:
    """(typo, answers) of a DataFrame of lines (line_ix, value), as `typo_rows` reads them."""
    parts = lines.filter(~F.trim("value").startswith("#") & F.contains("value", F.lit("=>"))).select(
        "line_ix",
        F.lower(F.trim(F.split_part("value", F.lit("=>"), F.lit(1)))).alias("typo"),
        F.filter(F.transform(F.split(F.split_part("value", F.lit("=>"), F.lit(2)), r"\|"), lambda a: F.trim(a)), lambda a: a != "").alias("answers"),
    )
    return parts.filter("typo <> '' AND size(answers) > 0").groupBy("typo").agg(F.max_by("answers", "line_ix").alias("answers"))


def confusable_rows(text: str = CONFUSABLES) -> list[tuple[str, list[str], str, int]]:
    """(section, key tokens, value, file_ix); rows that change nothing are dropped. Longest keys first, then file order."""
    section, rows = "always", []
    for i, line in enumerate(text.splitlines()):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("["):
            section = "always" if line == "[always wrong]" else "meaning"
            continue
        mark = "=>" if section == "always" else "|"
        if mark not in line:
            continue
        left, right = (p.strip() for p in line.split(mark, 1))
        key = left.lower().split()
        if key and right and " ".join(key) != right.lower():
            rows.append((section, key, right, i))
    return sorted(rows, key=lambda r: (r[0], -len(r[1]), r[3]))


def confusable_table(spark: SparkSession, text: str = CONFUSABLES) -> DataFrame:
    return local_table(spark, confusable_rows(text), "section string, key array<string>, value string, file_ix int")


def confusable_lines(lines: DataFrame) -> DataFrame:
    """(section, key, value, file_ix) of lines (line_ix, value): the section runs on from its heading.

    The table is a small file; its running section is one ordered window.
    """
    heading = F.when(F.trim("value") == "[always wrong]", "always").when(F.trim("value") == "[depends on meaning]", "meaning")
    run = Window.orderBy("line_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(run), F.lit("always")))
    mark = F.when(F.col("section") == "always", "=>").otherwise("|")
    key = F.split(F.lower(F.trim(F.split_part("value", mark, F.lit(1)))), r"\s+")
    value = F.trim(F.split_part("value", mark, F.lit(2)))
    rows = rows.filter(~F.trim("value").startswith("#") & ~F.trim("value").startswith("[") & F.contains("value", mark))
    rows = rows.select("section", key.alias("key"), value.alias("value"), F.col("line_ix").alias("file_ix"))
    return rows.filter((F.col("value") != "") & (F.array_join("key", " ") != F.lower("value")) & (F.array_join("key", " ") != ""))


def cardinalities(**tables: DataFrame) -> DataFrame:
    """(what, n): the number of rows of each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


@dataclass(frozen=True)
class Options:
    """Which rules run, and how the scorer is used."""

    unicode: bool = True
    spacing: bool = True
    punctuation: bool = True
    merge_dots: bool = True
    ellipsis_char: bool = False
    consistent_tone_style: bool = True
    bad_syllables: bool = True
    confusables: bool = True
    plain_words: bool = False
    threshold: float = 0.03
    blank_fill: bool = False
    write_report: bool = True

    @classmethod
    def load(cls, path: str) -> Options:
        """Options saved as JSON; a missing or damaged file gives the defaults, unknown keys are ignored."""
        try:
            saved = json.loads(Path(path).read_text("utf-8"))
            known = {f.name: saved[f.name] for f in fields(cls) if f.name in saved}
            if any(type(v) is not type(getattr(cls(), k)) for k, v in known.items()):
                return cls()
            return cls(**known)
        except (OSError, ValueError, TypeError):
            return cls()

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2), "utf-8")

    @classmethod
    def with_scoring(cls, blank_fill: bool, threshold: float | None = None, **rest) -> Options:
        """The scoring mode with the threshold that belongs to it, unless one is given."""
        return cls(blank_fill=blank_fill, threshold=threshold if threshold is not None else (0.018 if blank_fill else 0.03), **rest)
