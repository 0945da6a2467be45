"""Decisions on open cases, without a scorer or with one."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.editing import blank_window, sentence_window
from ..sources.lexicon import Options

#: Columns of an open case, beside the paragraph's keys.
CASE = ["start", "end", "before", "cands", "kind", "reason", "evidence"]


class Scorer(Protocol):
    """The one point of extension: how natural a text is, in nats per character; higher is better.

    Both methods take a column of texts. `score_blank` defaults to scoring the whole. A scorer that can share work between the fills of
    one window may have `score_fills(left, fills, right, blank)` too: the scores that the others would give, for each of `fills`.
    """

    def score(self, texts: pd.Series) -> pd.Series: ...

    def score_blank(self, before: pd.Series, fill: pd.Series, after: pd.Series) -> pd.Series: ...


class BigramScorer:
    """A small deterministic scorer: mean log-probability of character bigrams with add-one smoothing."""

    def __init__(self, texts: list[str]):
        self.pairs: dict[str, int] = {}
        self.singles: dict[str, int] = {}
        for t in texts:
            t = f" {t.lower()} "
            for a, b in zip(t, t[1:], strict=False):
                self.pairs[a + b] = self.pairs.get(a + b, 0) + 1
                self.singles[a] = self.singles.get(a, 0) + 1
        self.letters = max(1, len({c for p in self.pairs for c in p}))

    def _sum(self, text: str) -> float:
        t = text.lower()
        return sum(
            math.log((self.pairs.get(a + b, 0) + 1) / (self.singles.get(a, 0) + self.letters)) for a, b in zip(t, t[1:], strict=False)
        )

    def score(self, texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: self._sum(t) / len(t) if len(t) > 1 else 0.0)

    def score_blank(self, before: pd.Series, fill: pd.Series, after: pd.Series) -> pd.Series:
        """Scores the fill and what follows only; without any context, 0."""

        def one(b, f, a):
            if not b and not a:
                return 0.0
            return (self._sum(b + f + a) - self._sum(b)) / max(1, len(f + a))

        return pd.Series([one(*x) for x in zip(before, fill, after, strict=True)], dtype="float64")


class SharedBigramScorer(BigramScorer):
    """The same scores, but sums are whole numbers: what fills of one window share is summed once, and equal sums are equal in any order."""

    #: Log-probabilities are multiples of 1 / UNIT.
    UNIT = 1 << 44
    #: So many fills are remembered.
    MOST_FILLS = 100_000

    def __init__(self, texts: list[str]):
        super().__init__(texts)
        self._logs: dict[str, int] = {}
        self._fills: dict[str, tuple[str, int]] = {}

    def _log(self, a: str, b: str) -> int:
        x = self._logs.get(a + b)
        if x is None:
            # Pairs without a count differ by their first character only: that one entry serves them all.
            n = self.pairs.get(a + b, 0)
            key = a + b if n else a
            x = self._logs.get(key)
            if x is None:
                x = self._logs[key] = round(math.log((n + 1) / (self.singles.get(a, 0) + self.letters)) * self.UNIT)
        return x

    def _whole(self, low: str) -> int:
        log = self._log
        return sum(log(a, b) for a, b in zip(low, low[1:], strict=False))

    def _sum(self, text: str) -> float:
        return self._whole(text.lower()) / self.UNIT

    def _fill(self, fill: str) -> tuple[str, int]:
        found = self._fills.get(fill)
        if found is None:
            if len(self._fills) >= self.MOST_FILLS:
                self._fills.clear()
            found = self._fills[fill] = (low := fill.lower(), self._whole(low))
        return found

    def score_fills(self, left: str, fills: list[str], right: str, blank: bool) -> list[float]:
        if "Σ" in left or "Σ" in right or any("Σ" in f for f in fills):  # its lower case depends on what stands beside it
            n = len(fills)
            if blank:
                return self.score_blank(pd.Series([left] * n), pd.Series(fills), pd.Series([right] * n)).tolist()
            return self.score(pd.Series([left + f + right for f in fills])).tolist()
        a, b = left.lower(), right.lower()
        # Of a blank, what stands ahead is given: its own sum is not part of the score.
        shared = (0 if blank else self._whole(a)) + self._whole(b)
        out = []
        for fill in fills:
            low, total = self._fill(fill)
            total += shared
            if low:
                total += (self._log(a[-1], low[0]) if a else 0) + (self._log(low[-1], b[0]) if b else 0)
            elif a and b:
                total += self._log(a[-1], b[0])
            n = len(fill) + len(right) + (0 if blank else len(left))
            if blank:
                out.append(total / self.UNIT / max(1, n) if left or right else 0.0)
            else:
                out.append(total / self.UNIT / n if n > 1 else 0.0)
        return out


def log_softmax_at(logits, index: int) -> float:
    """Log-probability of one index; -20 where it is out of range."""
    if not 0 <= index < len(logits):
        return -20.0
    top = max(logits)
    return float(logits[index] - top - math.log(sum(math.exp(x - top) for x in logits)))


def without_scorer(cases: DataFrame) -> DataFrame:
    """Cases with `decided` (the replacement, or null: stays open) and `certainty`.

    A case with evidence takes its first candidate, and so does a bad syllable with a single one.
    """
    first = F.get("cands", F.lit(0))
    sure = (F.col("evidence") != "none") | ((F.size("cands") == 1) & (F.col("kind") == "bad_syllable"))
    return cases.withColumn("decided", F.when(sure, first)).withColumn("certainty", F.lit("likely"))


def choose(scores: list[float], original: float, threshold: float) -> int | None:
    """Index of the candidate that replaces the original, or None.

    The best one must beat the first by more than the threshold, else the first stands for it; that one must beat the
    original by more than the threshold. A score that is not a number, or infinite, never changes anything.
    """
    if not scores or not math.isfinite(original) or not math.isfinite(scores[0]):
        return None
    best = max(range(len(scores)), key=lambda i: (scores[i] if math.isfinite(scores[i]) else -math.inf, -i))
    if best and not scores[best] - scores[0] > threshold:
        best = 0
    return best if scores[best] - original > threshold else None


def with_scorer(cases: DataFrame, scorer: Scorer, options: Options) -> DataFrame:
    """As `without_scorer`, but cases without evidence are scored: original and candidates in one and the same window.

    `cases` also needs text, and to fill blanks before_text and after_text (the neighbouring paragraphs); none of them is returned. No case is left open.
    """
    first = F.get("cands", F.lit(0))
    texts = ["text", "before_text", "after_text"]
    names = [c for c in cases.columns if c not in texts]
    wanted = ["start", "end", "before", "cands", *(texts if options.blank_fill else texts[:1])]
    settled = cases.filter("evidence <> 'none'").select(*names, first.alias("decided"), F.lit("likely").alias("certainty"))
    asked = cases.filter("evidence = 'none'").select(*names, *wanted[4:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = getattr(scorer, "score_fills", None)
        for batch in batches:
            rows = batch.select(wanted).to_pylist()
            parts: list[tuple[str, str, str]] = []
            shared: list[list[float]] = []
            for r in rows:
                if options.blank_fill:
                    left, right = blank_window(r["before_text"], r["text"], r["after_text"], r["start"], r["end"])
                else:
                    lo, hi = sentence_window(r["text"], r["start"], r["end"])
                    left, right = r["text"][lo : r["start"]], r["text"][r["end"] : hi]
                fills = [r["before"], *r["cands"]]
                if share:
                    shared.append(share(left, fills, right, options.blank_fill))
                else:
                    parts += [(left, fill, right) for fill in fills]
            frame = pd.DataFrame(parts, columns=["left", "fill", "right"], dtype="object")
            if share:
                scores = [x for own in shared for x in own]
            elif options.blank_fill:
                scores = scorer.score_blank(frame["left"], frame["fill"], frame["right"]).tolist()
            else:
                scores = scorer.score(frame["left"] + frame["fill"] + frame["right"]).tolist()
            at, decided = 0, []
            for r in rows:
                n = len(r["cands"])
                pick = choose(scores[at + 1 : at + 1 + n], scores[at], options.threshold)
                decided.append(None if pick is None else r["cands"][pick])
                at += 1 + n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(decided, pa.string()), pa.array(["doubtful"] * len(rows), pa.string())],
                [*names, "decided", "certainty"],
            )

    scored = asked.mapInArrow(run, settled.schema)
    kind = F.when(F.col("kind").isin("glued", "bad_syllable"), F.when(F.contains("decided", F.lit(" ")), "glued").otherwise("bad_syllable")).otherwise(F.col("kind"))
    return settled.unionByName(scored.withColumn("kind", F.when(F.col("decided").isNull(), F.col("kind")).otherwise(kind)))
