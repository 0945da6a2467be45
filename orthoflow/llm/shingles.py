"""Word-shingle sets of texts as sorted 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .chunk_cache import flat_bytes

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same in every process."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHTS = stream(1 << 12, 1) | U(1)
#: Bytes of spans that are hashed at a time, so a long text takes little beside itself.
STEP = 1 << 20


def _span_sums(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    total = np.cumsum(stops - starts)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + STEP, side="right")))
        lengths = stops[lo:hi] - starts[lo:hi]
        at = np.cumsum(lengths) - lengths
        place = np.arange(at[-1] + lengths[-1]) - np.repeat(at, lengths)
        terms = (fold[raw[place + np.repeat(starts[lo:hi], lengths)]].astype(U) + U(1)) * weights[place]
        out[lo:hi] = np.add.reduceat(terms, at)
        lo = hi
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, none empty, after `fold`; spans longer than `weights` go by pieces of that length."""
    if len(starts) == 0:
        return np.zeros(0, U)
    most = len(weights)
    pieces = (stops - starts + most - 1) // most
    if pieces.max() == 1:
        return mix(_span_sums(raw, starts, stops, fold, weights))
    first = np.cumsum(pieces) - pieces
    nth = np.arange(first[-1] + pieces[-1]) - np.repeat(first, pieces)
    begin = np.repeat(starts, pieces) + nth * most
    hashes = mix(_span_sums(raw, begin, np.minimum(begin + most, np.repeat(stops, pieces)), fold, weights))
    return np.add.reduceat(hashes * (mix(nth.astype(U)) | U(1)), first)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, edges of each text's words). A-Z count as a-z; `texts` has no nulls."""
    raw, ends = flat_bytes(texts)
    n = len(texts)
    if len(raw) == 0:
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    solid = _SOLID[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | first[:-1]))
    stops = np.flatnonzero(solid & np.concatenate([~solid[1:] | first[1:-1], [True]])) + 1
    return span_hashes(raw, starts, stops, _LOWER, _WEIGHTS), np.searchsorted(starts, ends)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct `size`-word shingles of each text; a text with fewer words has its whole sequence as one."""
    words, edges = word_hashes(texts)
    many = max(0, len(words) - size + 1)
    rolled = np.zeros(many, U)
    for i in range(size):
        rolled = mix(rolled * U(0x9E3779B97F4A7C15) + words[i : i + many] + U(i + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            h = np.zeros(1, U)
            for i in range(a, b):
                h = mix(h * U(0x9E3779B97F4A7C15) + words[i] + U(i - a + 1))
            yield h
        else:
            yield np.zeros(0, U)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 16-bit symbol per (a, b): of the least hash a * x + b over the set."""
    least = np.full(len(a), np.iinfo(U).max, U)
    for lo in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[lo : lo + 4096, None] * a + b).min(0), out=least)
    return (mix(least) >> U(48)).astype(np.uint16)


def text_slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of its `text` (no nulls), so long texts stay within memory."""
    size = np.cumsum(np.diff(flat_bytes(batch.column("text"))[1]))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
