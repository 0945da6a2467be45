"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

Templates are cut into words (runs of letters and digits, lower-cased) and their K-word hashes are winnowed: of each
window of W successive hashes the least is a fingerprint, kept in an inverted index of (hash, template, position).
Any K + W - 1 successive words shared with a template therefore hit its index. Scattered changes can leave no K words in
succession, so the index also holds single words, the anchors: of a template of n words, a match that may miss m of them has
one of any m + 1; the m + 1 that look rarest are anchors. A document's hashes are probed all at once; hits of a
template on near diagonals are one candidate region, and a local alignment in a band around those diagonals gives matched
words, coverage and the span. The band is as wide as an alignment with a positive score can stray, so it loses nothing:
a match is found as without a band and an index. The index is as small as the template set and goes to every task; documents
are scanned in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunk_cache import flat_bytes
from .shingles import U, mix, span_hashes, stream, text_slices

K, W, BAND, MIN_COVERAGE = 3, 3, 8, 0.8
MATCH, MISMATCH, GAP = 2, -1, -1

#: Public notices, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "proprietary": ["All rights reserved."],
}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHTS = stream(1 << 12, 6) | U(1)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, stop byte of each word, edges of each text's words, text offsets)."""
    raw, ends = flat_bytes(texts)
    solid = _WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:] = ~solid[:-1] | first[1:-1]
    after[:-1] = ~solid[1:] | first[1:-1]
    starts, stops = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    edges = np.searchsorted(starts, ends)
    return span_hashes(raw, starts, stops, _LOWER, _WEIGHTS), starts, stops, edges, ends


def _grams(words: np.ndarray) -> np.ndarray:
    many = max(0, len(words) - K + 1)
    out = np.zeros(many, U)
    for i in range(K):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[i : i + many] + U(i + 1))
    return out


def winnow(grams: np.ndarray, window: int = W) -> np.ndarray:
    """Positions of the fingerprints: the last least hash of each window; of all hashes, where fewer."""
    if len(grams) == 0:
        return np.zeros(0, np.int64)
    window = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], 1))


def least_matched(length: int, min_coverage: float) -> int:
    """The fewest matched words, one at least, that make `min_coverage` of a template of `length` words."""
    return next((m for m in range(1, length + 1) if m >= min_coverage * length), length + 1)


def reach(length: int, need: int) -> int:
    """How many diagonals an alignment with a positive score that matches `need` of `length` words can lie from any of its words.

    At most length - need template words are skipped; skipped document words cost a gap each, a match pays for MATCH of them.
    """
    return max(BAND, length - need + MATCH * length)


class TemplateIndex:
    """Inverted index of the templates' fingerprints, and of their anchors for matches of `min_coverage`."""

    def __init__(self, templates: Mapping[str, list[str]], min_coverage: float = MIN_COVERAGE):
        self.names, self.words, self.need = [], [], []
        hashes, of, at = [], [], []
        spread: Counter[int] = Counter()
        letters: dict[int, int] = {}
        for name, texts in templates.items():
            for text in texts:
                words, starts, stops, _, _ = _words(pa.array([text]))
                spread.update(set(words.tolist()))
                letters.update(zip(words.tolist(), (stops - starts).tolist(), strict=True))
                grams = _grams(words)
                picked = winnow(grams)
                if not len(picked):
                    raise ValueError(f"template of {name!r} has fewer than {K} words")
                hashes.append(grams[picked])
                of.append(np.full(len(picked), len(self.names)))
                at.append(picked)
                self.names.append(name)
                self.words.append(words)
                self.need.append(least_matched(len(words), min_coverage))
        self.fingerprints = self._sorted(hashes, of, at)
        hashes, of, at = [], [], []
        for t, words in enumerate(self.words):
            # A guess at what is rare: long words that few templates share. Only speed depends on it.
            rarest = sorted(range(len(words)), key=lambda q: (spread[int(words[q])] / letters[int(words[q])], q))
            picked = np.array(rarest[: len(words) - self.need[t] + 1], np.int64)
            hashes.append(words[picked])
            of.append(np.full(len(picked), t))
            at.append(picked)
        self.anchors = self._sorted(hashes, of, at)

    @staticmethod
    def _sorted(*columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        hashes, of, at = (np.concatenate(x) for x in columns)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], of[order], at[order]

    @staticmethod
    def _probe(table: tuple[np.ndarray, ...], keys: np.ndarray) -> list[tuple[int, int, int]]:
        hashes, of, at = table
        if not len(hashes):
            return []
        lo = np.searchsorted(hashes, keys)
        found = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == keys)
        hi = np.searchsorted(hashes, keys[found], side="right")
        return [(int(of[e]), p, int(at[e])) for p, a, b in zip(found.tolist(), lo[found].tolist(), hi.tolist(), strict=True) for e in range(a, b)]

    def hits(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, gram position, template position) of all grams that are fingerprints."""
        return self._probe(self.fingerprints, grams)

    def anchor_hits(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, word position, template position) of all words that are anchors."""
        return self._probe(self.anchors, words)


def _ends(doc: np.ndarray, template: np.ndarray, low: int, high: int, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, matched, start, stop) of the best local alignment that ends at each doc word, of those that match `need` words or more.

    Only cells with low <= doc position - template position <= high count. A cell is one integer: score, matched, start.
    """
    low, high = max(low, -len(template)), min(high, len(doc) - 1)
    if low > high or not len(doc):
        return (np.zeros(0, np.int64),) * 4
    width = high - low + 1
    start_bits, matched_bits = len(doc).bit_length(), len(template).bit_length()
    one, point = 1 << start_bits, 1 << start_bits + matched_bits
    steps = np.arange(width) * -GAP * point
    padded = np.zeros(len(template) + width, np.uint64)
    at = np.arange(len(padded)) + low
    inside = (at >= 0) & (at < len(doc))
    padded[inside] = doc[at[inside]]
    best = np.zeros(len(padded), np.int64)
    above = np.zeros(width + 1, np.int64)
    for t, word in enumerate(template):
        here, is_doc = at[t : t + width], inside[t : t + width]
        diagonal = above[:-1]
        begun = diagonal + MATCH * point + one + np.where(diagonal > 0, 0, here)
        row = np.where(padded[t : t + width] == word, begun, diagonal + MISMATCH * point)
        row = np.where(is_doc, np.maximum(row, above[1:] + GAP * point), 0)
        row = np.maximum.accumulate(row + steps) - steps
        row[(row < point) | ~is_doc] = 0
        above[:-1] = row
        best[t : t + width] = np.maximum(best[t : t + width], np.where((row >> start_bits) % (point // one) >= need, row, 0))
    ends = np.flatnonzero(best)
    cells = best[ends]
    return cells // point, (cells >> start_bits) % (point // one), cells % one, at[ends] + 1


def align(doc: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with low <= doc position - template position <= high: (matched words, start, stop in doc)."""
    score, matched, start, stop = _ends(doc, template, low, high, 1)
    if not len(score):
        return 0, 0, 0
    first = np.lexsort((stop, -matched, -score))[0]
    return int(matched[first]), int(start[first]), int(stop[first])


def align_all(doc: np.ndarray, template: np.ndarray, low: int, high: int, need: int) -> list[tuple[int, int, int]]:
    """Disjoint local alignments that match `need` words or more, the best first: (matched words, start, stop in doc)."""
    score, matched, start, stop = _ends(doc, template, low, high, need)
    taken = np.zeros(len(doc), bool)
    out = []
    for e in np.lexsort((stop, -matched, -score)).tolist():
        a, b = int(start[e]), int(stop[e])
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((int(matched[e]), a, b))
    return out


def scan_words(doc: np.ndarray, hits: list[tuple[int, int, int]], index: TemplateIndex) -> list[tuple[int, int, int, int]]:
    """(template, matched words, start word, stop word) of one document's matches, overlaps resolved.

    Of overlapping matches the one with more matched words stays, then the earlier, then the earlier template. What the
    accepted matches leave of a region is aligned again, until nothing in it reaches the index's coverage.
    """
    by_template: dict[int, set[int]] = {}
    for t, p, q in hits:
        by_template.setdefault(t, set()).add(p - q)
    parts = []
    for t, diagonals in by_template.items():
        places = np.sort(np.fromiter(diagonals, np.int64))
        words, need = index.words[t], index.need[t]
        far = reach(len(words), need)
        cuts = np.flatnonzero(np.diff(places) > far)
        for low, high in zip(places[np.r_[0, cuts + 1]].tolist(), places[np.r_[cuts, -1]].tolist(), strict=True):
            low, high = low - far, high + far
            a, b = max(0, low), min(len(doc), high + len(words))
            if np.count_nonzero(np.isin(words, doc[a:b])) >= need:
                parts.append((t, low, high, a, b))
    out: list[tuple[int, int, int, int]] = []
    taken = np.zeros(len(doc) + 1, bool)
    while parts:
        found, fertile = set(), []
        for t, low, high, a, b in parts:
            need = index.need[t]
            here = align_all(doc[a:b], index.words[t], low - a, high - a, need) if b - a >= need else []
            if here:
                fertile.append((t, low, high, a, b))
                found.update((t, matched, start + a, stop + a) for matched, start, stop in here)
        for m in sorted(found, key=lambda m: (-m[1], m[2], m[0])):
            if not taken[m[2] : m[3]].any():
                taken[m[2] : m[3]] = True
                out.append(m)
        parts = []
        for t, low, high, a, b in fertile:
            edges = np.flatnonzero(np.diff(np.r_[True, taken[a:b], True])).reshape(-1, 2)
            parts += [(t, low, high, a + lo, a + hi) for lo, hi in edges.tolist()]
    return sorted(out, key=lambda m: m[2])


def scan(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, matched (words), coverage (of the template's words), start, stop (characters).

    Whole texts are scanned. Null, empty and unmatched texts give no row; every row of `docs` is scanned for itself, with null and
    repeated doc_ids too. Other columns are not read.
    """
    schema = "doc_id bigint, license string, matched int, coverage double, start int, stop int"
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
    names = ["doc_id", "license", "matched", "coverage", "start", "stop"]
    index = TemplateIndex(templates, min_coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in text_slices(b)):
            words, starts, stops, edges, ends = _words(part.column("text"))
            raw, _ = flat_bytes(part.column("text"))
            grams = _grams(words)
            hits: dict[int, list] = {}
            for found, size in ((index.hits(grams), K), (index.anchor_hits(words), 1)):
                for t, p, q in found:
                    doc = int(np.searchsorted(edges, p, side="right")) - 1
                    if p + size <= edges[doc + 1]:
                        hits.setdefault(doc, []).append((t, p - int(edges[doc]), q))
            rows = []
            ids = part.column("doc_id")
            for doc, mine in hits.items():
                lo, hi = int(edges[doc]), int(edges[doc + 1])
                for t, matched, a, b in scan_words(words[lo:hi], mine, index):
                    base, first, last = int(ends[doc]), int(starts[lo + a]), int(stops[lo + b - 1])
                    start = len(raw[base:first].tobytes().decode("utf-8", "replace"))
                    stop = start + len(raw[first:last].tobytes().decode("utf-8", "replace"))
                    rows.append((ids[doc].as_py(), index.names[t], matched, matched / len(index.words[t]), start, stop))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "coalesce(CAST(text AS string), '') AS text").mapInArrow(run, schema)
