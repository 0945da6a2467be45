"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked: its spaces become U+2581 and one is set ahead. No piece holds a mark after another character or a
newline, so the best segmentation of a text is that of its marked words (marks and what follows up to the
next mark or newline), one after another. Distinct marked words are sorted, which lists the leaves of their trie depth-first:
a word keeps the forward states of the prefix it shares with the word before it and only goes on from there.

A forward state is the last piece of the best segmentation of a prefix, and what makes one best is the model's kind:

- unigram: the path with the largest sum of piece scores wins, the longer piece among equals; a character
  without a piece costs the least score less 10.
- BPE: a segmentation is the one that merging gives exactly if each two successive pieces, merged alone, stay those two. So of
  the pieces that end at a place just one goes with the state where it begins, and the search needs no scores of paths.

Both give the library's own ids. A character without a piece becomes its UTF-8 bytes. Other kinds of model, models with a
normaliser other than identity, without the 256 byte pieces or with user-defined pieces are refused.

A U+2581 of the text itself is a mark to the format, as in the library: it is encoded as one and decodes to a space.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import text_or_empty
from .chunk_cache import ChunkCache, encode_chunks, flat_bytes, release_memory, take_runs
from .shingles import text_slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SLICE_BYTES = 4 << 20
#: Pairs of pieces remembered per worker; beyond it they are looked at afresh. About 250 bytes each.
STABLE_PAIRS = 500_000
NEVER = float("-inf")


class PieceModel:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError(f"{path}: only models without normalisation are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: marks at word ends are not supported")
        if proto.trainer_spec.model_type not in (proto.trainer_spec.UNIGRAM, proto.trainer_spec.BPE):
            raise ValueError(f"{path}: only unigram and BPE models are supported")
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.prefix = spec.add_dummy_prefix
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            surface = b""
            if p.type == kind.NORMAL:
                self.pieces[p.piece] = (i, p.score)
                surface = p.piece.replace(MARK, " ").encode()
            elif p.type == kind.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                surface = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                surface = " ⁇ ".encode()
            elif p.type != kind.CONTROL:
                raise ValueError(f"{path}: user-defined and unused pieces are not supported")
            self.surface.append(surface)
        if len(self.bytes) != 256:
            raise ValueError(f"{path}: only models with all byte pieces are supported")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces):
            raise ValueError(f"{path}: a piece goes over a word's start or a newline")
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self._score = {p: s for p, (_, s) in self.pieces.items()}.get
        self._stable: dict[tuple[str, str], bool] = {}

    def _ids(self, word: str, back: list[tuple[int, int]]) -> list[int]:
        out, at = [], len(word)
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass"))]
            at = start
        return out[::-1]

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: again and again the neighbours that make the best piece, the leftmost of equals."""
        score, parts = self._score, list(text)
        gains = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (top := max(gains)) > NEVER:
            at = gains.index(top)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def stable(self, left: str, right: str) -> bool:
        """Whether merging leaves these two pieces as they are, side by side; of one piece alone (`left` empty), whether it makes it."""
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) >= STABLE_PAIRS:
                self._stable.clear()
            known = self._stable[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def _step_scores(self, word: str, end: int, best: list[float], back: list[tuple[int, int]]) -> None:
        top, edge = float("-inf"), (end - 1, -1)
        for start in range(max(0, end - self.longest), end):
            found = self.pieces.get(word[start:end])
            if found is not None and best[start] + found[1] > top:
                top, edge = best[start] + found[1], (start, found[0])
        if word[end - 1] not in self.pieces and best[end - 1] + self.unknown_score > top:
            top, edge = best[end - 1] + self.unknown_score, (end - 1, -1)
        best.append(top)
        back.append(edge)

    def _step_merges(self, word: str, end: int, back: list[tuple[int, int]]) -> None:
        pieces, known = self.pieces, self._stable
        for start in range(max(0, end - self.longest), end):
            piece = word[start:end]
            if (found := pieces.get(piece)) or end - start == 1:
                left = word[back[start][0] : start]
                ok = known.get((left, piece))
                if self.stable(left, piece) if ok is None else ok:
                    back.append((start, found[0] if found else -1))
                    return
        raise AssertionError(f"no piece ends at {end} of {word!r}")  # what merging gives for the prefix always does

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each marked word (with spaces for marks), by a depth-first walk of their trie."""
        marked = [w.replace(" ", MARK) for w in words]
        out: list[list[int]] = [[]] * len(words)
        best, back, last = [0.0], [(0, 0)], ""
        for k in sorted(range(len(words)), key=marked.__getitem__):
            word = marked[k]
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if self.merges:
                    self._step_merges(word, end, back)
                else:
                    self._step_scores(word, end, best, back)
            out[k] = self._ids(word, back)
            last = word
        return out


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Where marked words begin: before a run of spaces, and before and after newlines."""
    cut = np.zeros(len(raw), bool)
    if len(raw) > 1:
        space, line = raw == 0x20, raw == 0x0A
        cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return cut


@functools.cache
def _codec(path: str) -> tuple[PieceModel, ChunkCache, np.ndarray, np.ndarray, np.ndarray]:
    model = PieceModel(path)
    lengths = np.array([len(s) for s in model.surface], np.int64)
    return model, ChunkCache(model.encode_words), np.frombuffer(b"".join(model.surface), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, count of each text); an empty text has none."""
    model, cache, *_ = _codec(path)
    raw, ends = flat_bytes(texts)
    if model.prefix:
        some = np.diff(ends) > 0
        raw = np.insert(raw, ends[:-1][some], 0x20)
        ends = ends + np.concatenate([[0], np.cumsum(some)])
    return encode_chunks(raw, ends, word_starts, cache)


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): pieces joined, marks as spaces, without the leading mark that encoding set."""
    model, _, surface, starts, lengths = _codec(path)
    ids = ids.astype(np.int64)
    raw = take_runs(surface, starts[ids], lengths[ids])
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    if model.prefix and len(raw):
        some = np.diff(ends) > 0
        lead = ends[:-1][some]
        gone = lead[raw[lead] == 0x20]
        raw = np.delete(raw, gone)
        ends = ends - np.concatenate([[0], np.cumsum(np.isin(ends[:-1], gone) & some)])
    return raw, ends


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Every row of `docs` as (doc_id, ids); null and empty texts have no ids. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in text_slices(b, SLICE_BYTES)):
            ids, counts = encode_texts(part.column("text"), path)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "coalesce(text, '') AS text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Every row (doc_id, ids) as (doc_id, text); null ids give an empty text, bytes that are not UTF-8 U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            counts = lists.value_lengths().to_numpy().astype(np.int64)
            raw, ends = decode_ids(lists.flatten().to_numpy(), counts, path)
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("CAST(doc_id AS bigint) AS doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Every row of `docs` encoded and decoded again: doc_id, n_tokens, ids_crc32 (of u32 little-endian), same (text is restored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in text_slices(b, SLICE_BYTES)):
            ids, counts = encode_texts(part.column("text"), path)
            raw, ends = decode_ids(ids, counts, path)
            own, own_ends = flat_bytes(part.column("text"))
            if np.array_equal(raw, own) and np.array_equal(ends, own_ends):
                same = np.ones(part.num_rows, bool)
            else:
                same = np.array([np.array_equal(raw[a:b], own[c:d]) for a, b, c, d in zip(ends, ends[1:], own_ends, own_ends[1:], strict=False)])
            edges = np.concatenate([[0], np.cumsum(counts)])
            wide = ids.astype("<u4")
            sums = [zlib.crc32(wide[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "same"])
            pa.default_memory_pool().release_unused()
        release_memory()

    rows = docs.select("doc_id", text_or_empty().alias("text")).selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, same boolean")
