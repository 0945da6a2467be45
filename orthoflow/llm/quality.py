"""Quality classifier: a generalised additive model with pairwise interactions over features of the text.

Cyclic boosting: each round visits every feature and fits one shallow tree (at most `LEAVES` leaves) to the
gradient of the log loss over that feature's bins; the tree's leaf values are added to the feature's lookup table. Then the
pairs of features whose coarse 2-d bins explain most of the remaining gradient get tables of their own, boosted the
same way. A score is the sigmoid of an intercept and one table look-up per feature and pair: vectorised additions.

The model is fitted on at most `SAMPLE_ROWS` labelled rows, those with the least hashed doc_id, and is a few kB. Only the text
is seen by a score. Features are counts over the whole text, made in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty
from .chunk_cache import flat_bytes, release_memory
from .shingles import STEP, U, span_hashes, stream

#: The most labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
BINS, COARSE, LEAVES, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, L2 = 48, 12, 4, 150, 60, 8, 0.1, 2.0

FEATURES = (
    "log_bytes log_words log_lines word_len_mean word_len_max long_words short_words upper_share digit_share punct_share "
    "space_share symbol_share bang_share pipe_share wide_share upper_words word_repeats adjacent_repeats line_repeats "
    "distinct_words line_len_mean end_marks byte_entropy vowel_share mark_run_share open_upper comma_share"
).split()


def _class_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


_SPACE = _class_table(b" \t\n\x0b\x0c\r")
_UPPER, _DIGIT = _class_table(bytes(range(65, 91))), _class_table(b"0123456789")
_PUNCT, _SYMBOL = _class_table(b".,;:!?'\"()-"), _class_table(b"#$%&*+/<=>@[\\]^_`{|}~")
_VOWEL, _WIDE = _class_table(b"aeiouyAEIOUY"), _class_table(bytes(range(128, 256)))
_SOLID, _IS_UPPER, _MARK = _SPACE == 0, _UPPER > 0, _PUNCT + _SYMBOL > 0
_AS_IS, _WEIGHTS = np.arange(256, dtype=np.uint8), stream(1 << 12, 7) | U(1)


def _byte_counts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each text holds each byte."""
    out = np.zeros((len(ends) - 1, 256))
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for lo in range(a, b, STEP):
            out[i] += np.bincount(raw[lo : min(b, lo + STEP)], minlength=256)
    return out


def features(texts: pa.Array) -> np.ndarray:
    """One row of `FEATURES` per text; an empty text has zeros. `texts` has no nulls."""
    raw, ends = flat_bytes(texts)
    n = len(texts)
    if n == 0 or len(raw) == 0:
        return np.zeros((n, len(FEATURES)))
    size = np.diff(ends).astype(np.float64)
    some = np.maximum(size, 1)

    def text_of(at):
        return np.searchsorted(ends, at, side="right") - 1

    # Texts are cut apart: a word or line never runs over the end of a text.
    first = np.zeros(len(raw) + 1, bool)
    first[ends[:-1]] = True
    solid = _SOLID[raw]
    start = solid & (np.concatenate([[True], ~solid[:-1]]) | first[:-1])
    starts = np.flatnonzero(start)
    stop = solid & np.concatenate([~solid[1:] | first[1:-1], [True]])
    stops = np.flatnonzero(stop) + 1
    w_doc, w_len = text_of(starts), stops - starts
    words = np.bincount(w_doc, minlength=n).astype(np.float64)
    some_words = np.maximum(words, 1)
    w_hash = span_hashes(raw, starts, stops, _AS_IS, _WEIGHTS)

    def by_word(x):
        return np.bincount(w_doc, x, n)

    upper = np.cumsum(_IS_UPPER[raw], dtype=np.int32)
    caps = (upper[stops - 1] - upper[starts] + _IS_UPPER[raw[starts]]) * 2 > w_len
    del upper
    opens = _UPPER[raw[starts]]
    keyed = np.lexsort((w_hash, w_doc))
    s_doc, s_hash = w_doc[keyed], w_hash[keyed]
    fresh = np.ones(len(s_doc), bool)
    fresh[1:] = (s_doc[1:] != s_doc[:-1]) | (s_hash[1:] != s_hash[:-1])
    distinct = np.bincount(s_doc[fresh], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(fresh), len(s_doc)))
    top_word = np.zeros(n)
    np.maximum.at(top_word, s_doc[fresh], runs)
    adjacent = np.zeros(len(starts), bool)
    adjacent[1:] = (w_hash[1:] == w_hash[:-1]) & (w_doc[1:] == w_doc[:-1])

    line_solid = raw != 10
    l_start = np.flatnonzero(line_solid & (np.concatenate([[True], ~line_solid[:-1]]) | first[:-1]))
    l_stop = np.flatnonzero(line_solid & np.concatenate([~line_solid[1:] | first[1:-1], [True]])) + 1
    l_doc = text_of(l_start)
    lines = np.bincount(l_doc, minlength=n).astype(np.float64)
    l_hash = span_hashes(raw, l_start, l_stop, _AS_IS, _WEIGHTS)
    order = np.lexsort((l_hash, l_doc))
    o_doc, o_hash = l_doc[order], l_hash[order]
    again = np.bincount(o_doc[1:], (o_doc[1:] == o_doc[:-1]) & (o_hash[1:] == o_hash[:-1]), n) if len(o_doc) else np.zeros(n)
    marks = np.isin(raw[l_stop - 1], np.frombuffer(b".!?:;\"", np.uint8))

    counts = _byte_counts(raw, ends)
    share = counts / some[:, None]
    entropy = -np.sum(np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0), 1)

    def part(table):
        return counts @ table / some

    mark = _MARK[raw]
    after_mark = np.flatnonzero(mark[1:] & mark[:-1] & ~first[1:-1]) + 1
    longest = np.zeros(n)
    np.maximum.at(longest, w_doc, w_len)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), by_word(w_len) / some_words, np.log1p(longest), by_word(w_len > 12) / some_words,
        by_word(w_len <= 2) / some_words, part(_UPPER), part(_DIGIT), part(_PUNCT), part(_SPACE), part(_SYMBOL), counts[:, 33] / some,
        counts[:, 124] / some, part(_WIDE), by_word(caps) / some_words, top_word / some_words, by_word(adjacent) / some_words,
        again / np.maximum(lines, 1), distinct / some_words, np.log1p(size / np.maximum(lines, 1)), np.bincount(l_doc, marks, n) / np.maximum(lines, 1),
        entropy, part(_VOWEL), np.bincount(text_of(after_mark), minlength=n) / some, by_word(opens) / some_words, counts[:, 44] / some,
    ]
    out = np.stack(columns, 1)
    out[size == 0] = 0
    return out


@dataclass
class GamModel:
    """Lookup tables of the additive model; `scores` adds them up."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h):
    return g * g / (h + L2)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf value of each bin: greedy best splits of the ordered bins into at most `leaves` runs."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    runs = [(0, len(g))]

    def best(a, b):
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        left, right = _gain(cg[k] - cg[a], ch[k] - ch[a]), _gain(cg[b] - cg[k], ch[b] - ch[k])
        gain = left + right - _gain(cg[b] - cg[a], ch[b] - ch[a])
        at = int(np.argmax(gain))
        return float(gain[at]), int(k[at])

    while len(runs) < leaves:
        options = [(*best(a, b), a, b) for a, b in runs]
        gain, k, a, b = max(options)
        if gain <= 1e-9:
            break
        runs.remove((a, b))
        runs += [(a, k), (k, b)]
    values = np.zeros(len(g))
    for a, b in runs:
        values[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + L2)
    return values


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a 2-d table: the best split of one axis, then each side's best split of the other axis."""
    found = None
    for axis in (0, 1):
        ga, ha = (g, h) if axis == 0 else (g.T, h.T)
        values, gain = np.zeros_like(ga), -1.0
        for k in range(1, len(ga)):
            v, total = np.empty_like(ga), 0.0
            for part in (slice(0, k), slice(k, None)):
                leaf = _shallow_tree(gp := ga[part].sum(0), hp := ha[part].sum(0), 2)
                v[part] = leaf
                total -= float((gp * leaf + 0.5 * (hp + L2) * leaf * leaf).sum())
            if total > gain:
                values, gain = v, total
        if found is None or gain > found[0]:
            found = gain, values if axis == 0 else values.T
    return found[1]


def fit(x: np.ndarray, y: np.ndarray) -> GamModel:
    """Fit the tables; with fewer than two classes the score is the share of ones (0.5 without rows)."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = GamModel(float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j in range(d):
            p = 1 / (1 + np.exp(-margin))
            n = len(model.tables[j])
            step = RATE * _shallow_tree(np.bincount(bins[j], p - y, n), np.bincount(bins[j], p * (1 - p), n))
            model.tables[j] += step
            margin += step[bins[j]]
    model.coarse = [np.minimum(np.arange(len(t)) * COARSE // len(t), COARSE - 1) for t in model.tables]
    low = [c[b] for c, b in zip(model.coarse, bins, strict=True)]
    p = 1 / (1 + np.exp(-margin))
    ranked = []
    for i in range(d):
        for j in range(i + 1, d):
            cell = low[i] * COARSE + low[j]
            g, h = np.bincount(cell, p - y, COARSE**2), np.bincount(cell, p * (1 - p), COARSE**2)
            ranked.append((float(_gain(g, h).sum()), i, j))
    chosen = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in chosen:
            p = 1 / (1 + np.exp(-margin))
            cell = low[i] * COARSE + low[j]
            shape = (COARSE, COARSE)
            step = RATE * _pair_tree(np.bincount(cell, p - y, COARSE**2).reshape(shape), np.bincount(cell, p * (1 - p), COARSE**2).reshape(shape))
            table += step
            margin += step[low[i], low[j]]
    model.pairs = chosen
    return model


def held_out(doc_id):
    """crc32(doc_id as text) mod 5 = 0; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> GamModel:
    """Fit on rows of `labels` (doc_id, quality) that are not held out; null and other labels than 0 and 1 are skipped.

    At most `sample_rows` rows are taken, by least hash of doc_id, so the chosen rows don't depend on partitioning.
    Repeated labels of one doc_id count once, by the larger value.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("l_id"), "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select(text_or_empty().alias("text"), "y", "doc_id")
    got = rows.mapInArrow(_feature_rows, "doc_id bigint, y int, x array<double>").orderBy("doc_id", "y").collect()
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], np.float64))


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text, so a batch of long texts stays within memory."""
    size = np.cumsum(np.diff(flat_bytes(batch.column("text").fill_null(""))[1]))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            x = features(part.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("y").cast(pa.int32()), lists], ["doc_id", "y", "x"])
    release_memory()


def score(docs: DataFrame, model: GamModel, threshold: float = 0.3) -> DataFrame:
    """Every row of `docs` as (doc_id, score, predicted): predicted is 1 where score >= threshold.

    A null text is empty, and empty texts are scored by the tables like others. Rows with null or repeated
    doc_ids each get a row. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                s = model.scores(features(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
                )
        release_memory()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: GamModel, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` with score >= threshold, all columns kept."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                x = features(part.column("text").fill_null(""))
                yield part.filter(pa.array(model.scores(x) >= threshold))
        release_memory()

    return docs.mapInArrow(run, schema)
