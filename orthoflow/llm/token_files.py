"""Token-id files: one shared zstandard dictionary, each document compressed on its own, an offset index.

File format, all numbers little-endian. A shard `part-NNNNN.tok` is
    magic "OFTK" | version u32 | sha256 of the dictionary (32 bytes) | the documents' frames, one after another
    | index: one row of `INDEX` a document, in order | number of documents u64 | offset of the index u64 | magic "OFTK"
A frame is a zstandard frame, made with the shared dictionary, of the document's ids as unsigned 32-bit
integers. `dictionary.zst` beside the shards is the dictionary. The index gives each document's doc_id, place and
token count, so that one short document is read with two small reads and no others are decompressed.

Documents are range-partitioned by doc_id, so shards and the rows within them ascend. A shard is written under a
name of its own attempt and then renamed, so a task that runs again replaces whole files only.

The dictionary is trained on the ids of at most `SAMPLE_DOCS` documents, those with the least hashed doc_id: of each a run of
`SAMPLE_IDS` ids that begins at a hashed place of its whole id array. It only affects the size of the files, never their
contents. It is as large as an eighth of what it is trained on, up to `DICTIONARY_BYTES`. Where that is too little for any
training (a few documents), the dictionary is empty, and frames are made without one.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, text_or_empty
from .chunk_cache import CACHE_CHUNKS, ChunkCache, encode_chunks, flat_bytes, release_memory, word_cuts
from .shingles import text_slices

MAGIC, VERSION = b"OFTK", 1
HEADER = struct.Struct("<4sI32s")
FOOTER = struct.Struct("<QQ4s")
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8")])
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 1000, 2048, 64 << 10, 3
#: Ids in one training sample, and the least dictionary in bytes.
SAMPLE_CUT, LEAST_DICTIONARY = 256, 256
END_ID = 0
JOINED = 2000  # chunks in one string
SLICE_BYTES = 8 << 20  # of text encoded at once


@functools.cache
def _encoder(tokenizer_path: str, cache_chunks: int) -> ChunkCache:
    """One per worker process: the tokenizers library encodes each distinct chunk once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    opens = np.array([(tok.id_to_token(i) or "").startswith("\u0120") for i in range(tok.get_vocab_size())])

    def encode_many(chunks: list[str]) -> list[list[int]]:
        """Chunks with one space, their first character, go in long strings: there each opens with a space token."""
        plain = [c[0] == " " and c.count(" ") == 1 for c in chunks]
        strings = [c for c, p in zip(chunks, plain, strict=True) if p]
        joined = ["".join(strings[i : i + JOINED]) for i in range(0, len(strings), JOINED)]
        parts: list[list[int]] = []
        for e in tok.encode_batch_fast(joined, add_special_tokens=False):
            ids = e.ids
            edges = np.flatnonzero(opens[np.array(ids, np.int64)]).tolist()
            parts += [ids[a:b] for a, b in zip(edges, [*edges[1:], len(ids)], strict=True)]
        if len(parts) != len(strings):  # a vocabulary with other space tokens
            parts = [e.ids for e in tok.encode_batch_fast(strings, add_special_tokens=False)]
        others = iter(tok.encode_batch_fast([c for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False))
        rest = iter(parts)
        return [next(rest) if p else next(others).ids for p in plain]

    return ChunkCache(encode_many, cache_chunks)


def encode_texts(texts: pa.Array, tokenizer_path: str, end_id: int | None = END_ID, cache_chunks: int = CACHE_CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts as one array, count of ids of each text), `end_id` appended to each; `cache_chunks` bounds the cache."""
    raw, ends = flat_bytes(texts)
    ids, counts = encode_chunks(raw, ends, word_cuts, _encoder(tokenizer_path, cache_chunks))
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def _write(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes, tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    fs, path = pafs.FileSystem.from_uri(folder)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
    part = TaskContext.get().partitionId()
    name, own = f"part-{part:05d}.tok", f"{path}/.{uuid.uuid4().hex}"
    rows, at, total = [], HEADER.size, 0
    with fs.open_output_stream(own) as f:
        f.write(HEADER.pack(MAGIC, VERSION, hashlib.sha256(dictionary).digest()))
        for batch in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            doc_ids = batch.column("doc_id")
            ids, counts = encode_texts(batch.column("text"), tokenizer_path)
            ids = ids.astype("<u4")
            for doc_id, ids_of in zip(doc_ids.to_pylist(), np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [], strict=True):
                frame = packer.compress(ids_of.tobytes())
                f.write(frame)
                rows.append((doc_id or 0, doc_id is None, at, len(frame), len(ids_of)))
                at += len(frame)
                total += len(ids_of)
            pa.default_memory_pool().release_unused()
        f.write(np.array(rows, INDEX).tobytes())
        f.write(FOOTER.pack(len(rows), at, MAGIC))
    fs.move(own, f"{path}/{name}")
    release_memory()
    yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "n_docs": [len(rows)], "n_ids": [total]})


class TokenShard:
    """Random access to one shard."""

    def __init__(self, folder: str, part: int, dictionary: bytes):
        fs, path = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{path}/part-{part:05d}.tok")
        magic, version, digest = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or version != VERSION or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"shard {part} of {folder}: not a token file of this dictionary")
        n, at, _ = FOOTER.unpack(self.file.read_at(FOOTER.size, self.file.size() - FOOTER.size))
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, row: int) -> np.ndarray:
        r = self.index[row]
        return np.frombuffer(self._unpack.decompress(self.file.read_at(int(r["size"]), int(r["offset"]))), "<u4")


def _read_back(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard = TokenShard(folder, part, dictionary)
            for lo in range(0, len(shard.index), 4096):
                index = shard.index[lo : lo + 4096]
                docs = [shard.ids(lo + i) for i in range(len(index))]
                counts = np.array([len(d) for d in docs], np.int64)
                if not np.array_equal(counts, index["n_tokens"].astype(np.int64)):
                    raise ValueError(f"shard {part} of {folder}: index and frames disagree")
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(index["doc_id"], pa.int64(), mask=index["is_null"] == 1),
                        pa.array(starts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def _sample_ids(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
        ids, counts = encode_texts(batch.column("text"), tokenizer_path)
        runs = []
        for place, of in zip(batch.column("place").to_pylist(), np.split(ids.astype("<u4"), np.cumsum(counts)[:-1]), strict=True):
            start = int(place * max(0, len(of) - SAMPLE_IDS + 1))
            runs.append(of[start : start + SAMPLE_IDS].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, pa.binary())], ["doc_id", "ids"])
    release_memory()


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary from runs of ids anywhere in at most SAMPLE_DOCS documents; empty where they are too little to train on."""
    # Ids alone are ordered; the bounded list of chosen ones then fetches the texts.
    ids = docs.select(F.col("doc_id").alias("s_id")).filter("s_id IS NOT NULL").distinct().orderBy(F.xxhash64("s_id"), "s_id").limit(SAMPLE_DOCS)
    text = text_or_empty()
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id", text), F.lit(1 << 20)) / (1 << 20)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("s_id")).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), place.alias("place"))
    got = chosen.mapInArrow(lambda b: _sample_ids(b, tokenizer_path), "doc_id bigint, ids binary").groupBy("doc_id").agg(F.max("ids").alias("ids")).orderBy("doc_id").collect()
    samples = [r["ids"][at : at + 4 * SAMPLE_CUT] for r in got for at in range(0, len(r["ids"]), 4 * SAMPLE_CUT)]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if size < LEAST_DICTIONARY:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples, or nothing in them repeats
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str) -> tuple[DataFrame, bytes]:
    """Write `docs` (doc_id, text) to shards in `folder`; returns (shard, n_docs, n_ids) and the dictionary.

    Documents ascend by doc_id over the shards in order, null doc_ids first; rows with equal doc_ids ascend by a hash of their
    text. A null text is empty and has the end id only. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    dictionary = train_dictionary(docs, tokenizer_path)
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{path}/dictionary.zst") as f:
        f.write(dictionary)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th", "text")
    shards = ordered.mapInArrow(lambda b: _write(b, folder, dictionary, tokenizer_path), "shard int, n_docs bigint, n_ids bigint")
    return scratch.table(shards, "shards"), dictionary


def read_token_files(shards: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32 of its ids as u32.

    The starts of the shards are a running sum over one row per shard; documents are added up within.
    """
    counts = sorted((r["shard"], r["n_ids"]) for r in shards.collect())
    starts, total = [], 0
    for shard, n in counts:
        starts.append((shard, total))
        total += n
    spark = shards.sparkSession
    placed = spark.createDataFrame(starts, "shard int, start bigint").repartition(max(1, len(starts)), "shard")
    return placed.mapInArrow(lambda b: _read_back(b, folder, dictionary), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write `docs` to token files in the shared folder and return what the files hold (see `read_token_files`)."""
    folder = Scratch(docs.sparkSession, "token-files").mkdirs("shards")
    shards, dictionary = write_token_files(docs, tokenizer_path, folder)
    return read_token_files(shards, folder, dictionary)
