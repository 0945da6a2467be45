"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

Signatures have 32 symbols of 16 bits; the distance of two is the number of symbols that differ. They are
split into 8 chunks of 4 symbols. If two signatures differ in at most 15 symbols, some chunk has at most 15 // 8 = 1
error, so enumerating the allowed error (each symbol of each chunk left out in turn: 32 keys of 3 symbols)
makes every such pair meet under a key. A pair with Jaccard similarity 0.8 has more than 15 differing symbols
with probability 1.44e-4, P(Binomial(32, 0.2) >= 16), about one in 7000; nearer pairs less.

1. Texts with equal shingle sets are one class (128-bit set fingerprint), so copies cost one row from here on.
2. Classes that meet under a key and lie within the signature distance form coarse groups. A key with more than
   `HEAVY` classes first has its classes compared with its hub, the middle of a sample. Up to `ASKED` classes that this
   does not join to the hub are compared with all of the key, in blocks. A key with more of them is refined: the other 7
   chunks hold at most 15 errors, so one of them has at most 2, and a pair also meets under that chunk's 2 remaining
   symbols. Keys yield spanning forests, not pairs.
3. Full sets of grouped classes only are rebuilt from the texts, and each coarse group is confirmed exactly. A
   group above `GROUP` classes or `CELL_BYTES` of sets is not gathered in one task: its members are compared with a
   few hubs, wherever they are; those not linked to the main hub's links (the query set) are then compared with all
   members of a similar set size, in blocks.
4. Links are spanning forests of the confirmed pairs; their connected components are the result.

No partner or candidate is capped; hot groups are split. Only heavy keys (at most rows / HEAVY) and hubs may be broadcast,
behind a check of their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, Scratch, keep_rows, rows, small_side, text_or_empty
from .chunk_cache import release_memory
from .components import components
from .shingles import U, shingle_sets, signature, stream, text_slices

SYMBOLS, CHUNKS, ERRORS = 32, 8, 15
PER_CHUNK = SYMBOLS // CHUNKS
HEAVY, GROUP, HUBS, BLOCK, ASKED = 1000, 1500, 4, 500, 256
#: Bytes of sets that a task gathers of a group, or of a cell of a larger one, beyond its first two sets.
CELL_BYTES = 64 << 20
_A, _B = stream(SYMBOLS, 2) | U(1), stream(SYMBOLS, 3)
_F1, _F2 = stream(2, 4)

_CHUNK = [f"c{i}" for i in range(CHUNKS)]
_LOW = [f"s{i}" for i in range(CHUNKS // 2)]
_SKETCH = "doc_id bigint, th bigint, n bigint, f1 bigint, f2 bigint, " + ", ".join(f"{c} bigint" for c in _CHUNK + _LOW)


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Set size, set fingerprint, signature chunks, and the signature's low bytes (a lower bound of the distance)."""
    from .shingles import mix

    for batch in batches:
        for part in text_slices(batch):
            n = np.zeros(part.num_rows, np.int64)
            prints = np.zeros((2, part.num_rows), U)
            sig = np.zeros((part.num_rows, SYMBOLS), np.uint16)
            for i, s in enumerate(shingle_sets(part.column("text"), words)):
                n[i] = len(s)
                if len(s):
                    prints[:, i] = mix(s ^ _F1).sum(dtype=U), mix(s ^ _F2).sum(dtype=U)
                    sig[i] = signature(s, _A, _B)
            chunks = sig.view(np.int64).reshape(-1, CHUNKS)
            low = (sig & 0xFF).astype(np.uint8).view(np.int64).reshape(-1, CHUNKS // 2)
            columns = [part.column("doc_id"), part.column("th"), pa.array(n), *(pa.array(x.view(np.int64)) for x in prints)]
            columns += [pa.array(np.ascontiguousarray(x)) for x in (*chunks.T, *low.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n", "f1", "f2", *_CHUNK, *_LOW])
    release_memory()


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols, by their low bytes, of rows of signatures."""
    return (a != b).sum(-1)


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


def _within(run: np.ndarray) -> np.ndarray:
    """For the rows of one key: each row's first row of its component under the signature distance.

    Rows with the same `comp` are one component from the start.
    """
    sizes, low = run["n"], _low(run)
    _, first, which = np.unique(run["comp"], return_index=True, return_inverse=True)
    root = first[which]
    for i in range(1, len(run)):
        near = np.flatnonzero(_sizes_fit(sizes[:i], sizes[i]) & (root[:i] != root[i]))
        near = near[_far(low[near], low[i]) <= ERRORS]
        for r in np.unique(root[near]):
            lo, hi = sorted((root[i], r))
            root[root == hi] = lo
    return root


def _low(rows: np.ndarray) -> np.ndarray:
    return np.stack([rows[s] for s in _LOW], 1).view(np.uint8)


class _Forest:
    """Edges that a task has not yet implied; at `most` nodes it starts afresh, which only repeats edges."""

    def __init__(self, most: int = 500_000):
        self.up: dict[int, int] = {}
        self.most = most

    def _top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def new(self, a: int, b: int) -> bool:
        a, b = self._top(a), self._top(b)
        if a == b:
            return False
        if len(self.up) > self.most:
            self.up.clear()
        self.up[max(a, b)] = min(a, b)
        return True


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tag, key, cls, comp, n, low bytes) to a spanning forest of each key's pairs within the signature distance."""
    kind = np.dtype([(c, "<i8") for c in _COLUMNS])
    held = np.zeros(0, kind)
    forest = _Forest()

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows["tag"][1:] != rows["tag"][:-1]) | (rows["key"][1:] != rows["key"][:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(rows)))
        x, y = rows[at[size == 2]], rows[at[size == 2] + 1]
        ok = (_far(_low(x), _low(y)) <= ERRORS) & _sizes_fit(x["n"], y["n"]) & (x["comp"] != y["comp"])
        pairs = list(zip(x["cls"][ok].tolist(), y["cls"][ok].tolist(), strict=True))
        for lo, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            run = rows[lo : lo + n]
            root = _within(run)
            moved = np.flatnonzero(root != np.arange(n))
            moved = moved[run["comp"][moved] != run["comp"][root[moved]]]
            pairs += zip(run["cls"][root[moved]].tolist(), run["cls"][moved].tolist(), strict=True)
        pairs = [p for p in pairs if forest.new(*p)]
        return _edge_batch(pairs)

    for batch in batches:
        rows = np.empty(batch.num_rows, kind)
        for c in kind.names:
            rows[c] = batch.column(c).to_numpy()
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        last = (rows["tag"] == rows["tag"][-1]) & (rows["key"] == rows["key"][-1])
        cut = int(np.argmax(last))
        held = rows[cut:]
        if cut:
            yield edges(rows[:cut])
    if len(held):
        yield edges(held)


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(at[:, 0])), pa.array(np.ascontiguousarray(at[:, 1]))], ["a", "b"])


_COLUMNS = ["tag", "key", "cls", "comp", "n", *_LOW]


def _first_keys(classes: DataFrame) -> DataFrame:
    """32 rows per class: the chunk with each symbol left out, whose place holds the (chunk, symbol) tag."""
    keys = []
    for i in range(CHUNKS):
        for p in range(PER_CHUNK):
            kept = F.col(f"c{i}").bitwiseAND(F.lit(~(0xFFFF << 16 * p) if p < 3 else 0x0000FFFFFFFFFFFF).cast("bigint"))
            keys.append(F.struct(F.lit(i * PER_CHUNK + p).cast("bigint").alias("tag"), kept.alias("key")))
    return classes.select("cls", "comp", "n", *_CHUNK, *_LOW, F.inline(F.array(*keys)))


def _second_keys(rows: DataFrame) -> DataFrame:
    """42 rows per row of a heavy key: two symbols of each other chunk, together with the first key."""
    keys = []
    for j in range(CHUNKS):
        for p in range(PER_CHUNK):
            for q in range(p):
                mask = sum(0xFFFF << 16 * t for t in (p, q))
                mask = mask - (1 << 64) if mask >= 1 << 63 else mask
                kept = F.xxhash64("tag", "key", F.col(f"c{j}").bitwiseAND(F.lit(mask).cast("bigint")))
                keys.append(F.struct(F.lit(j * 16 + p * 4 + q).cast("bigint").alias("tag2"), kept.alias("key2")))
    wide = rows.select("tag", "cls", "comp", "n", *_LOW, F.inline(F.array(*keys)))
    other = F.shiftright("tag2", 4) != F.shiftright("tag", 2)
    return wide.filter(other).select(F.col("tag2").alias("tag"), F.col("key2").alias("key"), "cls", "comp", "n", *_LOW)


def _split_heavy(keyed: DataFrame, heavy_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most `heavy_rows` rows, rows of the others or None)."""
    counts = keyed.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > heavy_rows).select("tag", "key")
    heavy = scratch.table(counts, "heavy")
    if not rows(heavy):
        return keyed, None
    some = small_side(heavy, 32)
    return keyed.join(some, ["tag", "key"], "left_anti"), keyed.join(some, ["tag", "key"], "left_semi")


def _meet(light: DataFrame) -> DataFrame:
    grouped = light.select(*_COLUMNS).repartition("tag", "key").sortWithinPartitions("tag", "key", "cls")
    return grouped.mapInArrow(_bucket_edges, "a bigint, b bigint")


def _key_hubs(heavy: DataFrame) -> DataFrame:
    """(tag, key, hub, hub_n, hub signature): of up to 64 classes of each heavy key, the one in their middle."""
    from pyspark.sql import Window as W

    def choose(batches):
        for run in _runs(batches, ["tag", "key"]):
            low = np.ascontiguousarray(np.stack([run.column(s).to_numpy() for s in _LOW], 1)).view(np.uint8)
            hub = int(np.argmin(_far(low[:, None, :], low[None, :, :]).sum(1)))
            row = run.slice(hub, 1).select(["tag", "key", "cls", "n", *_LOW])
            yield from row.rename_columns(["tag", "key", "hub", "hub_n", *(f"hub_{s}" for s in _LOW)]).to_batches()

    nth = F.row_number().over(W.partitionBy("tag", "key").orderBy(F.xxhash64("cls"), "cls"))
    sample = heavy.withColumn("nth", nth).filter(F.col("nth") <= 64).select("tag", "key", "cls", "n", *_LOW)
    schema = "tag bigint, key bigint, hub bigint, hub_n bigint, " + ", ".join(f"hub_{s} bigint" for s in _LOW)
    return sample.repartition("tag", "key").sortWithinPartitions("tag", "key").mapInArrow(choose, schema)


def _hub_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows beside their key's hub to the edges within the signature distance."""
    forest = _Forest()
    for batch in batches:
        if batch.num_rows:
            col = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            mine, hubs = (np.ascontiguousarray(np.stack([col[p + s] for s in _LOW], 1)).view(np.uint8) for p in ("", "hub_"))
            ok = (_far(mine, hubs) <= ERRORS) & _sizes_fit(col["n"], col["hub_n"]) & (col["cls"] != col["hub"])
            yield _edge_batch([p for p in zip(col["hub"][ok].tolist(), col["cls"][ok].tolist(), strict=True) if forest.new(*p)])


def coarse_edges(classes: DataFrame, scratch: Scratch, heavy_rows: int = HEAVY) -> DataFrame:
    """Edges (a, b) that connect every two classes within the signature distance."""
    keyed = _first_keys(classes.withColumn("comp", F.col("cls")))
    light, heavy = _split_heavy(keyed, heavy_rows, scratch)
    if heavy is None:
        return _meet(light).filter("a <> b")
    heavy = scratch.table(heavy, "heavy-rows")
    hubs = scratch.table(_key_hubs(heavy), "key-hubs")
    beside = heavy.join(small_side(hubs, 80), ["tag", "key"]).select("cls", "n", *_LOW, "hub", "hub_n", *(f"hub_{s}" for s in _LOW))
    stars = scratch.table(beside.mapInArrow(_hub_edges, "a bigint, b bigint"), "key-stars")
    joined = components(stars, scratch).select(F.col("node").alias("cls"), "root")
    # From here on only pairs of classes that the hubs have not joined matter, under light keys too.
    known = scratch.table(classes.join(joined, "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root"), "hub-comps")
    light = _first_keys(known).join(small_side(heavy.select("tag", "key").distinct(), 32), ["tag", "key"], "left_anti")
    out = stars.unionAll(_meet(light))
    heavy = scratch.table(heavy.drop("comp").join(known.select("cls", "comp"), "cls"), "heavy-comps")
    main = hubs.join(known.select(F.col("cls").alias("hub"), F.col("comp").alias("main")), "hub").select("tag", "key", "main")
    main = scratch.table(main, "main")
    odd = scratch.table(heavy.join(small_side(main, 48), ["tag", "key"]).filter("comp <> main").drop("main"), "odd")
    if not rows(odd):
        return out.filter("a <> b")
    size = heavy.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("all"))
    plan = odd.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("asked")).join(size, ["tag", "key"])
    plan = scratch.table(plan.withColumn("salts", F.ceil(F.col("all") / heavy_rows).cast("int")), "plan")
    few, many = plan.filter(F.col("asked") <= ASKED).select("tag", "key", "salts"), plan.filter(F.col("asked") > ASKED).select("tag", "key")
    cell = ["tag", "key", "salt"]
    salts = F.sequence(F.lit(0), F.col("salts") - 1)
    few = F.broadcast(few) if rows(plan) * 48 <= BROADCAST_BYTES else few
    asks = odd.join(few, ["tag", "key"])
    asks = asks.select("tag", "key", F.explode(salts).alias("salt"), "cls", "comp", "n", *_LOW, F.lit(True).alias("asks"))
    told = heavy.join(few, ["tag", "key"])
    told = told.select("tag", "key", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), "cls", "comp", "n", *_LOW, F.lit(False).alias("asks"))
    both = asks.unionByName(told).repartition(*cell).sortWithinPartitions(*cell)
    out = out.unionAll(both.mapInArrow(_ask_edges, "a bigint, b bigint"))
    left = scratch.table(heavy.join(many, ["tag", "key"], "left_semi"), "left")
    if rows(left):
        second = scratch.table(_second_keys(left), "second")
        light, rest = _split_heavy(second, heavy_rows, scratch)
        out = out.unionAll(_meet(light))
        if rest is not None:  # five symbols alike in thousands of classes: one coarse group, left to the exact step
            comps = scratch.table(rest.select("tag", "key", "comp").distinct(), "third")
            firsts = comps.groupBy("tag", "key").agg(F.min("comp").alias("a"))
            out = out.unionAll(comps.join(firsts, ["tag", "key"]).select("a", F.col("comp").alias("b")))
    return out.filter("a <> b")


def _ask_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of a heavy key to the edges between the classes that ask and those told, not of one component yet."""
    forest = _Forest()
    for run in _runs(batches, ["tag", "key", "salt"]):
        cls, comp, n, asks = (run.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "comp", "n", "asks"))
        low = np.ascontiguousarray(np.stack([run.column(s).to_numpy() for s in _LOW], 1)).view(np.uint8)
        pairs = []
        for i in np.flatnonzero(asks):
            near = np.flatnonzero((comp != comp[i]) & _sizes_fit(n, n[i]))
            near = near[_far(low[near], low[i]) <= ERRORS]
            pairs += [(int(cls[i]), int(cls[j])) for j in near]
        yield _edge_batch([p for p in pairs if forest.new(*p)])


class _Sets:
    """Sets of one gathered group in one array, for counting one set's intersections with all others at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, self.items = np.unique(np.concatenate(sets), return_inverse=True)
        self.edges = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(len(values), np.int64)

    def linked(self, i: int) -> np.ndarray:
        """Whether 100 * intersection >= 80 * union holds between set i and each set."""
        mine = self.items[self.edges[i] : self.edges[i] + self.sizes[i]]
        self.mark[mine] = 1
        both = np.add.reduceat(self.mark[self.items], self.edges)
        self.mark[mine] = 0
        return 100 * both >= 80 * (self.sizes + self.sizes[i] - both)


def confirm(sets: list[np.ndarray], ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs of `sets` (none empty); with `ask`, of those that a set in `ask` is part of.

    A set whose possible partners, by size, are all in its component already is skipped.
    """
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= 80 * (len(sets[0]) + len(sets[1]) - both) else []
    group = _Sets(sets)
    root = np.arange(len(sets))
    out = []
    for i in range(len(sets)) if ask is None else ask:
        able = _sizes_fit(group.sizes, group.sizes[i]) & (root != root[i])
        if not able.any():
            continue
        for j in np.flatnonzero(group.linked(i) & able):
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in `by`, from sorted batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new)])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            mine = tuple(c[lo] for c in columns)
            if held and mine != key:
                yield pa.Table.from_batches(held)
                held = []
            key = mine
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _load(blobs) -> list[np.ndarray]:
    return [np.frombuffer(b, U) for b in blobs.to_pylist()]


def _confirm_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, ["grp"]):
        cls = run.column("cls").to_numpy()
        _, first = np.unique(cls, return_index=True)  # rows that repeat a document
        sets = _load(run.column("items").take(pa.array(first)))
        if len(first) > 1:
            yield _edge_batch([(cls[first[i]], cls[first[j]]) for i, j in confirm(sets)])


def _confirm_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, ["grp", "block", "band", "salt"]):
        cls, asks = run.column("cls").to_numpy(), run.column("asks").to_numpy(zero_copy_only=False)
        order = np.lexsort((~asks, cls))
        _, first = np.unique(cls[order], return_index=True)
        keep = order[first]
        if asks[keep].any() and len(keep) > 1:
            pairs = confirm(_load(run.column("items").take(pa.array(keep))), np.flatnonzero(asks[keep]))
            yield _edge_batch([(cls[keep[i]], cls[keep[j]]) for i, j in pairs])


def _hub_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, items, hubs: their cls and items) to the links of a member with hubs."""
    for batch in batches:
        a, b = [], []
        for cls, items, hubs in zip(batch.column("cls").to_pylist(), batch.column("items").to_pylist(), batch.column("hubs").to_pylist(), strict=True):
            mine = np.frombuffer(items, U)
            for hub in hubs:
                theirs = np.frombuffer(hub["items"], U)
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                if hub["cls"] != cls and 100 * both >= 80 * (len(mine) + len(theirs) - both):
                    a.append(hub["cls"])
                    b.append(cls)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _hub_choice(sample: DataFrame) -> DataFrame:
    """Up to HUBS classes of each group's sample: those with the most sample members within the signature distance."""

    def choose(batches):
        for run in _runs(batches, ["grp"]):
            low = np.stack([run.column(s).to_numpy() for s in _LOW], 1)
            low = np.ascontiguousarray(low).view(np.uint8)
            far = (low[:, None, :] != low[None, :, :]).sum(2)
            # By least summed distance: the middle of a dense group links to most of it.
            left, hubs = np.ones(len(far), bool), []
            while left.any() and len(hubs) < HUBS:
                hub = int(np.argmin(np.where(left, far[:, left].sum(1), np.iinfo(np.int64).max)))
                hubs.append(hub)
                left &= far[hub] > ERRORS
                left[hub] = False
            cls = run.column("cls").to_numpy()[hubs]
            yield pa.RecordBatch.from_arrays([run.column("grp").combine_chunks().take(pa.array(hubs)), pa.array(cls)], ["grp", "cls"])

    return sample.repartition("grp").sortWithinPartitions("grp").mapInArrow(choose, "grp bigint, cls bigint")


def _large_links(members: DataFrame, classes: DataFrame, scratch: Scratch, block: int, cell_bytes: int) -> DataFrame:
    """Links of the groups that are too large for one task. members: (grp, cls, n, items).

    A cell compares about `block` members that ask with `block` that are told, and about `cell_bytes` of sets of either kind.
    """
    from pyspark.sql import Window as W

    key = members.select("grp", "cls").join(classes.select("cls", *_LOW), "cls")
    nth = F.row_number().over(W.partitionBy("grp").orderBy(F.xxhash64("cls"), "cls"))
    sample = key.withColumn("nth", nth).filter(F.col("nth") <= 256)
    hubs = scratch.table(_hub_choice(sample).join(members.select("grp", "cls", "items"), ["grp", "cls"]), "hubs")
    packed = hubs.dropDuplicates(["cls"]).groupBy("grp").agg(F.collect_list(F.struct("cls", "items")).alias("hubs"))
    packed = scratch.table(packed, "hub-sets", F.expr("aggregate(hubs, 64L, (n, h) -> n + 64 + length(h.items))"))
    beside = members.join(small_side(packed), "grp").select("cls", "items", "hubs")
    links = scratch.table(beside.mapInArrow(_hub_links, "a bigint, b bigint"), "hub-links")
    roots = components(links, scratch)
    main = roots.groupBy("root").count().join(roots, "root").join(hubs.select("grp", F.col("cls").alias("node")), "node")
    main = main.groupBy("grp").agg(F.max_by("root", F.struct("count", "root")).alias("root"))
    settled = scratch.table(roots.join(main, "root").select("grp", F.col("node").alias("cls")).distinct(), "settled")
    open_ = scratch.table(members.join(settled, ["grp", "cls"], "left_anti"), "open")
    # The query set in blocks against members of their size band and its neighbours: sizes of linked sets are within 4 : 5.
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.col("n") * 8) / cell_bytes)).cast("int")
    n_open, n_all = open_.groupBy("grp").agg(parts.alias("blocks")), members.groupBy("grp").agg(parts.alias("salts"))
    plan = scratch.table(n_open.join(n_all, "grp").select("grp", "blocks", "salts"), "plan")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    salts = F.sequence(F.lit(0), F.col("salts") - 1)
    asks = open_.join(small_side(plan, 32), "grp").select(
        "grp", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), F.explode(F.array(band - 1, band, band + 1)).alias("band"), "salts", "cls", F.lit(True).alias("asks"), "items"
    )
    asks = asks.select("grp", "block", "band", F.explode(salts).alias("salt"), "cls", "asks", "items")
    told = members.join(small_side(plan, 32), "grp").select(
        "grp", F.explode(each).alias("block"), band.alias("band"), F.pmod(F.xxhash64("cls", F.lit(5)), F.col("salts")).cast("int").alias("salt"), "cls", F.lit(False).alias("asks"), "items"
    )
    cell = ["grp", "block", "band", "salt"]
    found = asks.unionByName(told).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_confirm_blocks, "a bigint, b bigint")
    return links.unionAll(found)


def near_groups(
    docs: DataFrame, words: int = 4, heavy_rows: int = HEAVY, group_rows: int = GROUP, block: int = BLOCK, cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """Every row of `docs` as (doc_id, th, n_shingles, component_id, kept, grp).

    Words are runs of characters outside `[\\x20\\x09-\\x0D]`, A-Z lower-cased; a set holds the distinct
    `words`-word shingles, or a shorter text's whole sequence. Texts are linked when 100 * intersection >=
    80 * union. component_id is the smallest doc_id of the rows reachable over links, `kept` is doc_id =
    component_id. Null, empty and wordless texts have n_shingles 0 and stand alone. Rows with a null doc_id take
    part and get the smallest known doc_id of their component, or null; rows that repeat a doc_id each take part. th is a hash of the
    text that tells apart rows with one doc_id; grp is a number of the component, null without shingles. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    text = text_or_empty()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sketch = scratch.table(texts.mapInArrow(lambda b: _sketch(b, words), _SKETCH), "sketch")
    same = ["f1", "f2", "n"]
    grouped = sketch.filter("n > 0").groupBy(*same).agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("model"), *(F.min(c).alias(c) for c in _CHUNK + _LOW)
    )
    classes = scratch.table(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    groups = components(coarse_edges(classes, scratch, heavy_rows), scratch)
    chosen = groups.select(F.col("root").alias("grp"), F.col("node").alias("cls")).join(classes.select("cls", "n", "model.doc_id", "model.th"), "cls")
    chosen = scratch.table(chosen, "chosen")
    sized = chosen.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n") * 8).alias("bytes"))
    sized = sized.select("grp", ((F.col("size") > group_rows) | (F.col("size") > 2) & (F.col("bytes") > cell_bytes)).alias("big"))
    wanted = chosen.join(sized, "grp").select("grp", "cls", "big", "n", F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"))
    wanted = scratch.table(wanted, "wanted")
    picked = texts.join(small_side(wanted, 64), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")))

    def sets(batches):
        for batch in batches:
            for part in text_slices(batch):
                items = pa.array([s.tobytes() for s in shingle_sets(part.column("text"), words)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("grp", "cls", "big", "n")), items], ["grp", "cls", "big", "n", "items"])

    members = picked.select("grp", "cls", "big", "n", "text").mapInArrow(sets, "grp bigint, cls bigint, big boolean, n bigint, items binary")
    members = scratch.table(members, "members")
    small = members.filter("NOT big").select("grp", "cls", "items")
    links = small.repartition("grp").sortWithinPartitions("grp", "cls").mapInArrow(_confirm_groups, "a bigint, b bigint")
    large = members.filter("big").select("grp", "cls", "n", "items").dropDuplicates(["grp", "cls"])
    large = scratch.table(large, "large")
    if rows(large):
        links = links.unionAll(_large_links(large, classes, scratch, block, cell_bytes))
    roots = components(links, scratch)
    merged = roots.join(classes.select(F.col("cls").alias("node"), "least"), "node")
    ids = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = scratch.table(roots.join(ids, "root").select(F.col("node").alias("cls"), "component_id", "root"), "labels")
    named = classes.join(labels, "cls", "left").select(
        *(F.col(c).alias(f"k_{c}") for c in same), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "cls").alias("grp"),
    )
    joined = sketch.select("doc_id", "th", *same).join(named, [F.col(c) == F.col(f"k_{c}") for c in same], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "grp"
    )


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each group of near copies, with all its columns: its smallest doc_id's; of several such, the least hash's.

    Rows that repeat doc_id and text are one, also those without words, which stand alone. See `keep_rows` for how rows are found.
    """
    scratch = Scratch(docs.sparkSession, "near-keep")
    groups = near_groups(docs, words).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_hash"), "kept", "grp")
    keys = scratch.table(groups.groupBy("k_id", "k_hash", "kept", "grp").agg(F.count(F.lit(1)).alias("k_rows")), "keys")
    # Several kept texts of one group share their doc_id, or have none.
    several = keys.filter("kept AND grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("texts"), F.min("k_hash").alias("best"))
    several = scratch.table(several.filter("texts > 1").select("grp", "best"), "several")
    keys = keys.join(small_side(several, 32), "grp", "left").withColumn("stays", F.expr("kept AND (best IS NULL OR best = k_hash)"))
    gone = scratch.table(keys.filter("NOT stays").select("k_id", "k_hash"), "dropped")
    repeated = scratch.table(keys.filter("stays AND k_rows > 1").select("k_id", "k_hash"), "repeated")
    return keep_rows(docs, F.xxhash64(text_or_empty()), gone, repeated)
