"""Texts cut into chunks that encode independently, and a bounded cache of each distinct chunk's ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks kept per worker process; beyond it the cache starts afresh. About 50 bytes each, and looking them up takes as much
#: again. Idle workers keep theirs.
CACHE_CHUNKS = 1_500_000
#: Chunks encoded at a time.
FRESH_CHUNKS = 32_768
#: Bytes encoded at a time: a longer text is cut.
PART_BYTES = 8 << 20


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); `texts` without nulls."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def cut_texts(raw: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Cut texts before the bytes where `cut` holds and at their ends: (chunks, chunks of each text)."""
    starts = cut.copy()
    filled = ends[:-1][np.diff(ends) > 0]
    starts[filled] = True
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(raw)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return chunks, np.diff(np.searchsorted(at, ends))


def word_cuts(raw: np.ndarray) -> np.ndarray:
    """Where bytes may be cut so that a byte-level BPE with the usual pre-tokenizing pattern treats the chunks independently.

    No pre-token runs from a non-space to a space, so a cut before a space is safe wherever the character
    ahead of it is surely no white space: printable ASCII, or U+00C0 to U+00FF.
    """
    cut = np.zeros(len(raw), bool)
    if len(raw) > 1:
        before = raw[:-1]
        solid = (before > 0x20) & (before < 0x7F)
        solid[1:] |= (before[:-1] == 0xC3) & (before[1:] >= 0x80)
        cut[1:] = (raw[1:] == 0x20) & solid
    return cut


def long_parts(raw: np.ndarray, lo: int, hi: int, cuts: Callable[[np.ndarray], np.ndarray], most: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about `most` bytes that make up raw[lo:hi], cut where `cuts` allows; longer only where nothing does.

    Whether a cut is allowed must depend on the two bytes ahead of it and the byte behind it only.
    """
    step = min(most, 1 << 16)
    while hi - lo > most:
        at, look = None, lo + most - step
        while at is None and look < hi:
            first = max(look, lo + 1)
            places = np.flatnonzero(cuts(raw[max(lo, first - 2) : look + step])) + max(lo, first - 2)
            places = places[(places >= first) & (places < hi)]
            at = int(places[-1]) if len(places) else None
            look += step
        if at is None:
            break
        yield lo, at
        lo = at
    yield lo, hi


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] of every (s, n), one after another."""
    total = int(lengths.sum(dtype=np.int64))
    if not total:
        return values[:0]
    kind = np.int32 if total < 1 << 31 and len(values) < 1 << 31 else np.int64
    at = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


class ChunkCache:
    """Ids of chunks; `encode_many` gets each distinct chunk (as str) that the cache does not hold.

    Known chunks are one Arrow array, in which a batch's distinct chunks are looked up at once. New ones come sorted.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], most: int = CACHE_CHUNKS):
        self.encode_many, self.most = encode_many, most
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.starts, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.rows = self.used = 0

    def _add(self, fresh: pa.Array) -> None:
        """Encode `fresh` in parts, so that few of its strings and lists are there at a time."""
        for lo in range(0, len(fresh), FRESH_CHUNKS):
            got = self.encode_many(fresh[lo : lo + FRESH_CHUNKS].cast(pa.large_string()).to_pylist())
            counts = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum()))
            n, m = self.rows + lo, self.used
            while n + len(got) > len(self.starts):
                self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
            while m + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[m : m + len(flat)] = flat
            self.starts[n : n + len(got)] = m + np.cumsum(counts, dtype=np.int32) - counts
            self.counts[n : n + len(got)] = counts
            self.used = m + len(flat)
        self.rows += len(fresh)
        self.known = pa.concat_arrays([self.known, fresh])

    def encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, count of each chunk)."""
        if len(chunks) == 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary
        if len(self.known) + len(distinct) > self.most and len(self.known):
            self._clear()
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy().copy()
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = distinct.take(pa.array(missing))
            order = pc.sort_indices(fresh).to_numpy()
            at[missing[order]] = np.arange(self.rows, self.rows + len(missing), dtype=np.int32)
            self._add(fresh.take(pa.array(order)))
        which = at[coded.indices.to_numpy()]
        counts = self.counts[which]
        return take_runs(self.ids, self.starts[which], counts), counts


def encode_chunks(
    raw: np.ndarray, ends: np.ndarray, cuts: Callable[[np.ndarray], np.ndarray], cache: ChunkCache, most: int = PART_BYTES
) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, count of each text): texts are cut into chunks by `cuts`; more than `most` bytes are encoded in parts."""
    if len(raw) <= most:
        chunks, per_text = cut_texts(raw, ends, cuts(raw))
        ids, per_chunk = cache.encode(chunks)
        return ids, np.diff(np.concatenate([[0], np.cumsum(per_chunk)])[np.concatenate([[0], np.cumsum(per_text)])])
    out, counts = [], np.zeros(len(ends) - 1, np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for lo, hi in long_parts(raw, a, b, cuts, most):
            ids, _ = encode_chunks(raw[lo:hi], np.array([0, hi - lo]), cuts, cache, hi - lo)
            out.append(ids)
            counts[i] += len(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int32), counts


def release_memory() -> None:
    """Give freed memory back to the system; workers that wait for their next task would keep it."""
    import ctypes
    import sys

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
