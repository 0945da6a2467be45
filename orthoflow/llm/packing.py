"""Variable-capacity best-fit packing over counts of lengths, then a distributed assignment.

Best-fit decreasing looks only at lengths, so it runs on the histogram of lengths: at most as many entries as the largest
permitted capacity, whatever the number of documents. Bins with the same contents are one *pattern*
with a multiplicity, so each step moves many bins at once and the plan stays about as small as the histogram.

- Lengths go from long to short. A piece goes to the open bin with the least room that still holds it (best fit).
- When no open bin holds it, a bin of the least-cost size is opened: the capacity with the least
  cost(capacity) / expected fill, where the fill is the piece plus what shorter pieces are still there to
  fill the rest. All permitted capacities compete at each opening.
- At the end every bin is downsized to the least capacity that holds its contents.

Documents longer than the largest capacity are cut into full pieces and a rest: every token is packed.

The plan gives, for each length, runs of consecutive pieces (by doc_id, piece) that go to consecutive bins of one
pattern. Pieces are range-partitioned by (length, doc_id, row, piece), ranked by a count within their partition plus the
partitions' running sums, and matched to their run, so one popular length is spread over many tasks.

`pack` plans over lengths alone. `pack_texts` encodes texts, cuts their ids into pieces, plans over the pieces' lengths and brings
each bin's ids together: a packed sequence with the boundaries of the documents in it. A bin holds at most the
largest capacity, so no sequence is large.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, small_side, text_or_empty
from .chunk_cache import CACHE_CHUNKS, release_memory
from .shingles import text_slices
from .token_files import SLICE_BYTES, encode_texts

CAPACITIES = (1024, 2048, 4096, 8192)
#: Cost of a sequence besides its tokens: start-up of a step, in tokens.
OVERHEAD = 64


def default_cost(capacity: int) -> float:
    return capacity + OVERHEAD


@dataclass
class Pattern:
    """`count` bins, opened one after another from number `serial` on, with the same contents.

    parts: (length, pieces in each bin, rank of the first bin's first piece).
    """

    capacity: int
    room: int
    count: int
    serial: int
    parts: tuple[tuple[int, int, int], ...]


def plan_bins(histogram: dict[int, int], capacities=CAPACITIES, cost: Callable[[int], float] = default_cost) -> list[Pattern]:
    """Best-fit decreasing over `histogram` (length -> pieces); lengths are 1 to the largest capacity.

    Of open bins with the same room, the one of smaller capacity is filled first, then the one opened first. The result
    is that of placing the pieces one by one.
    """
    caps = sorted(set(capacities))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    open_bins: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    full: list[Pattern] = []
    left = sum(length * n for length, n in histogram.items())
    opened = 0

    def put(p: Pattern) -> None:
        if p.room == 0:
            full.append(p)
            return
        if p.room not in open_bins:
            bisect.insort(rooms, p.room)
            open_bins[p.room] = []
        bisect.insort(open_bins[p.room], p, key=lambda q: (q.capacity, q.serial))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 1 <= length <= caps[-1]:
            raise ValueError(f"length {length} is outside 1..{caps[-1]}")
        n, rank = histogram[length], 0
        left -= length * n
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                p = open_bins[room].pop(0)
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
                each = min(room // length, n)
                bins = min(p.count, n // each)
            else:
                # Pieces that wait behind this one may fill the rest of a new bin.
                waiting = left + length * (n - 1)
                fits = [c for c in caps if c >= length]
                room = min(fits, key=lambda c: (cost(c) / (length + min(c - length, waiting)), c))
                each = min(room // length, n)
                # The choice stays the same while enough waits to fill the largest bin.
                least = 1 + max(0, -((left + length - caps[-1]) // length))
                bins = max(1, min(n // each, (n - least) // each + 1))
                p = Pattern(room, room, bins, opened, ())
                opened += bins
            if bins < p.count:
                put(_split(p, bins))
            put(Pattern(p.capacity, room - each * length, bins, p.serial, (*p.parts, (length, each, rank))))
            rank += each * bins
            n -= each * bins
    return full + [p for r in rooms for p in open_bins[r]]


def _split(p: Pattern, first: int) -> Pattern:
    """The bins of `p` from number `first` on; `p` keeps the bins ahead of it."""
    parts = tuple((length, each, rank + each * first) for length, each, rank in p.parts)
    rest = Pattern(p.capacity, p.room, p.count - first, p.serial + first, parts)
    p.count = first
    return rest


def plan_rows(patterns: list[Pattern], capacities=CAPACITIES) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, each, first_bin, capacity, offset): pieces of a length by rank to bins.

    Piece number rank_from + i goes to bin first_bin + i // each, at offset + (i % each) * length. Bins are
    numbered from 0 in the order of `patterns`; capacity is what the bin is downsized to.
    """
    rows, first = [], 0
    for p in patterns:
        used, offset = p.capacity - p.room, 0
        capacity = next(c for c in sorted(capacities) if c >= used)
        for length, each, rank in p.parts:
            rows.append((length, rank, rank + each * p.count, each, first, capacity, offset))
            offset += each * length
        first += p.count
    return sorted(rows)


_OUT = "doc_id bigint, row bigint, piece int, start bigint, length int, bin_id bigint, capacity int, offset int"
_ORDER = ["length", "doc_id", "row", "piece"]
_SEGMENT = [("doc_id", "bigint"), ("row", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "int")]


def _assign(batches: Iterator[pa.RecordBatch], rows: dict[int, tuple], firsts: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        length = batch.column("length").to_numpy().astype(np.int64)
        part = batch.column("part").to_numpy().astype(np.int64)
        rank = np.empty(len(length), np.int64)
        cols = np.empty((3, len(length)), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], (length[1:] != length[:-1]) | (part[1:] != part[:-1])])) if len(length) else []
        for a, b in zip(edges, [*edges[1:], len(length)], strict=True):
            key = (int(part[a]), int(length[a]))
            at = seen.get(key, firsts[key])
            seen = {key: at + int(b - a)}  # a cell may run on in the next batch
            rank[a:b] = np.arange(at, at + b - a)
            start, each, first, capacity, offset = rows[key[1]]
            r = np.searchsorted(start, rank[a:b], side="right") - 1
            i = rank[a:b] - start[r]
            cols[:, a:b] = first[r] + i // each[r], capacity[r], offset[r] + (i % each[r]) * key[1]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "row", "piece", "start", "length")),
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
            ],
            ["doc_id", "row", "piece", "start", "length", "bin_id", "capacity", "offset"],
        )


def _place(placed: DataFrame, capacities, cost: Callable[[int], float]) -> tuple[DataFrame, int]:
    """Pieces (part, doc_id, row, piece, start, length), a scratch table in the order of length within part, to their bins.

    The second value counts the pieces of length 0, which are left out.
    """
    # Bounded: at most largest capacity + partitions rows, since a partition shares only its end lengths with others.
    cells = sorted((r["part"], r["length"], r["n"]) for r in placed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).collect())
    histogram: dict[int, int] = {}
    firsts: dict[tuple[int, int], int] = {}
    for part, length, count in cells:
        firsts[part, length] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + count
    empty = histogram.pop(0, 0)
    runs: dict[int, list] = {}
    for length, *row in plan_rows(plan_bins(histogram, capacities, cost), capacities):
        runs.setdefault(length, []).append(row)
    # (rank_from, each, first_bin, capacity, offset) of each length's runs
    arrays = {k: tuple(np.array(v, np.int64).T[[0, 2, 3, 4, 5]]) for k, v in runs.items()}
    some = placed.filter("length > 0").repartition("part").sortWithinPartitions("part", *_ORDER)
    return some.mapInArrow(lambda b: _assign(b, arrays, firsts), _OUT), empty


def _ranged(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    ranged = pieces.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id())
    return scratch.table(ranged, "pieces")


def pack(lengths: DataFrame, capacities=CAPACITIES, cost: Callable[[int], float] = default_cost) -> DataFrame:
    """Pack documents, rows of `lengths` (doc_id, n_tokens), into bins.

    Returns one row per piece: doc_id, piece (from 0), start (token of the document where it begins), length,
    bin_id, capacity (of the downsized bin), offset (place in the bin). Documents with a null or no positive
    n_tokens hold nothing to pack: they get one row with length 0 and null bin_id, capacity and offset. Rows with equal or
    null doc_ids are packed one by one. Other columns are not read.
    """
    scratch = Scratch(lengths.sparkSession, "packing")
    largest = max(capacities)
    n = F.greatest(F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.lit(0))
    docs = scratch.table(lengths.select(F.col("doc_id").cast("bigint").alias("doc_id"), n.alias("n")), "lengths")
    last = F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("int")
    pieces = docs.select("doc_id", F.lit(0).cast("bigint").alias("row"), "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * largest
    pieces = pieces.select("doc_id", "row", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest)).cast("int").alias("length"))
    placed = _ranged(pieces, scratch)
    packed, empty = _place(placed, capacities, cost)
    packed = packed.drop("row")
    if not empty:
        return packed
    none = placed.filter("length = 0").selectExpr(
        "doc_id", "piece", "start", "length", "CAST(NULL AS bigint) AS bin_id", "CAST(NULL AS int) AS capacity", "CAST(NULL AS int) AS offset"
    )
    return packed.unionAll(none)


def _token_pieces(batches: Iterator[pa.RecordBatch], tokenizer_path: str, largest: int, cache_chunks: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, text) to the pieces of their ids: doc_id, row, piece, start, length, ids."""
    for batch in (part for whole in batches for part in text_slices(whole, slice_bytes)):
        ids, counts = encode_texts(batch.column("text"), tokenizer_path, cache_chunks=cache_chunks)
        many = -(-counts // largest)
        of = np.repeat(np.arange(len(counts)), many)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(counts[of] - piece * largest, largest)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), pa.array(ids.astype(np.int32)))
        at = pa.array(of)
        columns = [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(piece, pa.int32()), pa.array(piece * largest, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(length, pa.int32()), lists], ["doc_id", "row", "piece", "start", "length", "ids"])
        pa.default_memory_pool().release_unused()
    release_memory()


def _id_slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` ids."""
    total = np.cumsum(batch.column("length").to_numpy(), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _join_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bin_id, offset) to one row per bin."""
    held: pa.Table | None = None

    def whole(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        bins = rows.column("bin_id").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        edges = np.append(first, len(bins)).astype(np.int32)
        flat = rows.column("ids").chunk(0).flatten()
        ends = np.concatenate([[0], np.cumsum(rows.column("length").to_numpy())])
        wide = flat.to_numpy().astype("<u4")
        sums = [zlib.crc32(wide[a:b]) for a, b in zip(ends[edges[:-1]], ends[edges[1:]], strict=True)]
        segments = pa.StructArray.from_arrays([rows.column(c).chunk(0) for c, _ in _SEGMENT], [c for c, _ in _SEGMENT])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bins[first]), rows.column("capacity").chunk(0).take(pa.array(first)), pa.array(np.diff(ends[edges]), pa.int32()),
                pa.ListArray.from_arrays(edges, segments), pa.ListArray.from_arrays(ends[edges].astype(np.int32), flat), pa.array(sums, pa.int64()),
            ],
            ["bin_id", "capacity", "n_tokens", "segments", "ids", "ids_crc32"],
        )

    for batch in (part for b in batches for part in _id_slices(b)):
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        bins = rows.column("bin_id").to_numpy()
        cut = int(np.argmax(bins == bins[-1]))  # the last bin may go on in the next batch
        held = rows.slice(cut)
        if cut:
            yield whole(rows.slice(0, cut))
    if held is not None:
        yield whole(held)
    release_memory()


def pack_texts(
    docs: DataFrame, tokenizer_path: str, capacities=CAPACITIES, cost: Callable[[int], float] = default_cost, cache_chunks: int = CACHE_CHUNKS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Packed sequences of all rows of `docs` (doc_id, text): bin_id, capacity, n_tokens, segments, ids, ids_crc32.

    A text's ids are those of the token files, with the end id; a null or empty text has that one only. `segments` lists the pieces in
    the bin, in order: doc_id, row (a number of the input row, which tells apart rows with equal or null doc_ids), piece,
    start (id of the document where the piece begins), length. `ids` are their ids, one after another, ids_crc32 the checksum of these as unsigned 32-bit little-endian
    integers. Other columns are not read. Workers keep the ids of at most `cache_chunks` distinct chunks and encode about `slice_bytes` of
    text at a time: less of either takes less memory and more time.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    largest = max(capacities)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    schema = "doc_id bigint, row bigint, piece int, start bigint, length int, ids array<int>"
    tokens = scratch.table(rows.mapInArrow(lambda b: _token_pieces(b, tokenizer_path, largest, cache_chunks, slice_bytes), schema), "tokens")
    placed = _ranged(tokens.drop("ids"), scratch)
    plan = scratch.table(_place(placed, capacities, cost)[0].select("row", "piece", "bin_id", "capacity", "offset"), "plan")
    scratch.drop(placed)
    beside = tokens.join(small_side(plan, 64), ["row", "piece"])
    columns = ["bin_id", "offset", "capacity", *(c for c, _ in _SEGMENT), "ids"]
    ordered = beside.select(*columns).repartition("bin_id").sortWithinPartitions("bin_id", "offset")
    kinds = ", ".join(f"{c}: {k}" for c, k in _SEGMENT)
    return ordered.mapInArrow(_join_bins, f"bin_id bigint, capacity int, n_tokens int, segments array<struct<{kinds}>>, ids array<int>, ids_crc32 bigint")


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words of the whole text (runs without `[\\x20\\x09-\\x0D]`) and one for the end."""
    return docs.select("doc_id", (F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")) + 1).alias("n_tokens"))
