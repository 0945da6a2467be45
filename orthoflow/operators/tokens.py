"""Tokens of paragraphs with their neighbours and gaps, from one array per paragraph: no shuffle, and but for `marked_tokens` no Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.charset import letter_class, letters_class_col

KEY = ["book_id", "entry_ix", "para_ix"]


def parts_col(text: Column, compat_lowercase_letters: bool = False) -> Column:
    """The text as alternating runs of letters and of anything else; joined, they are the text again."""
    c = letter_class(compat_lowercase_letters)
    return F.regexp_extract_all(text, F.lit(f"({c}+|[^{c[1:-1]}]+)"), F.lit(1))


def part_start(parts: Column, pos: Column) -> Column:
    """Code-point offset of part `pos` (from 0)."""
    return F.aggregate(F.slice(parts, F.lit(1), pos), F.lit(0), lambda n, p: n + F.length(p))


def tokens(paras: DataFrame, keys: list[str] = KEY, compat_lowercase_letters: bool = False, keep: Callable[[Column], Column] | None = None, starts: bool = False) -> DataFrame:
    """One row per token: keys, tok_ix, pos, tok, prev, next, gap (text ahead of it), gap_after, token_class; with `starts`, start.

    `prev` and `next` are the neighbouring tokens, null at the ends; null texts have no tokens. With `keep`, a condition on the
    token, others still count as neighbours but get no row of their own. `start`: the code-point offset in the text.
    """
    parts = F.col("parts")
    # Letters and others alternate, so the first part tells which places hold tokens.
    first = F.when(F.get(parts, F.lit(0)).rlike("^" + letter_class(compat_lowercase_letters)), 0).otherwise(1)
    places = F.when(F.size(parts) > first, F.sequence(first, F.size(parts) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    if keep is not None:
        places = F.filter(places, lambda i: keep(F.get(parts, i)))
    near = F.transform(
        places,
        lambda i: F.struct(
            i.alias("pos"), F.get(parts, i).alias("tok"), F.get(parts, i - 2).alias("prev"), F.get(parts, i + 2).alias("next"),
            F.get(parts, i - 1).alias("gap"), F.get(parts, i + 1).alias("gap_after"),
            *([F.length(F.array_join(F.slice(parts, F.lit(1), i), "")).alias("start")] if starts else []),
        ),
    )
    rows = paras.select(*keys, parts_col(F.col("text"), compat_lowercase_letters).alias("parts")).select(*keys, F.inline(near))
    return rows.select(
        *keys, F.shiftright("pos", 1).alias("tok_ix"), "pos", "tok", "prev", "next", "gap", "gap_after",
        letters_class_col(F.col("tok")).alias("token_class"), *(["start"] if starts else []),
    )


def marked_tokens(paras: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, tok, prev, next, token_class of the tokens that `has_marks` holds for, as `tokens` gives them: a kernel that looks at texts beyond ASCII only."""
    fields = ", ".join(f"{k} {paras.schema[k].dataType.simpleString()}" for k in keys)
    letters = letter_class()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"{letters}+").finditer
        for batch in batches:
            at, starts, toks, prevs, nexts = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if text is None or text.isascii():
                    continue
                words = [(m.start(), m.group()) for m in find(text)]
                last = len(words) - 1
                for i, (start, tok) in enumerate(words):
                    if not tok.isascii():
                        at.append(row)
                        starts.append(start)
                        toks.append(tok)
                        prevs.append(words[i - 1][1] if i else None)
                        nexts.append(words[i + 1][1] if i < last else None)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(rows) for k in keys), pa.array(starts, pa.int32()), *(pa.array(c, pa.string()) for c in (toks, prevs, nexts))],
                [*keys, "start", "tok", "prev", "next"],
            )

    found = paras.select(*keys, "text").mapInArrow(run, f"{fields}, start int, tok string, prev string, next string")
    return found.withColumn("token_class", letters_class_col(F.col("tok")))


def token_counts(paras: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tok, n): how often each token stands in the texts of each key.

    Texts are cut by a class of three ranges, which is fast, into runs that hold whole tokens. Those are counted, with partial
    aggregation, and only distinct ones are cut into the tokens themselves.
    """
    coarse = F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z\x{80}-\x{10FFFF}]+)"), F.lit(1))).alias("run")
    runs = paras.select(*keys, coarse).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"))
    toks = runs.select(*keys, F.explode(F.regexp_extract_all("run", F.lit(f"({letter_class()}+)"), F.lit(1))).alias("tok"), "n")
    return toks.groupBy(*keys, "tok").agg(F.sum("n").alias("n"))


def capitalised(c: Column) -> Column:
    return c.rlike(r"^\p{IsUppercase}")


def has_marks(c: Column) -> Column:
    """Whether a token holds a letter beyond ASCII: all `viet` tokens do."""
    return F.octet_length(c) != F.length(c)


def mid_sentence(gap: Column) -> Column:
    """A gap of only spaces, commas and semicolons: a capital behind it is a name's."""
    return gap.rlike("^[ ,;]*$")


def bigrams(toks: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Pairs of neighbouring tokens with exactly one space between: keys, tok_ix, first, second, prev, gap, first_class, second_class."""
    pairs = toks.filter((F.col("gap_after") == " ") & F.col("next").isNotNull())
    return pairs.select(
        *keys, "tok_ix", F.col("tok").alias("first"), F.col("next").alias("second"), "prev", "gap",
        F.col("token_class").alias("first_class"), letters_class_col(F.col("next")).alias("second_class"),
    )


def paragraph_context(paras: DataFrame, also: list[str] = []) -> DataFrame:
    """Each paragraph with the texts before and after it in its entry (empty at the ends); columns in `also` are kept and break ties."""
    order = Window.partitionBy("book_id", "entry_ix").orderBy("para_ix", *also)
    return paras.select(
        *also, *KEY, "text", F.coalesce(F.lag("text").over(order), F.lit("")).alias("before"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("after")
    )
