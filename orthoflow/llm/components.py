"""Connected components of an edge table: in one bounded task, or by alternating stars over scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, rows

#: Up to this many edges (16 MB) one task joins them; beyond it the distributed steps do.
LOCAL_EDGES = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each): the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        # Hook the roots themselves, then shorten all paths.
        for side in (x, y):
            np.minimum.at(new, root[side], least)
        while not np.array_equal(new, shorter := new[new]):
            new = shorter
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        nodes, root = roots_of(table.column("u").to_numpy(), table.column("v").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, scratch: Scratch, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of every node of `edges` (a, b bigint): root is the component's smallest node.

    `edges` should come without many repeats. Self-loops alone and edges with a null are dropped. In the distributed
    steps each node's smallest neighbour comes from an aggregate, combined in the map tasks, that is joined back to the
    edges, so a node with very many neighbours is split like any skewed join; no neighbour list is collected.
    """
    e = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if rows(e) <= local_edges:
        return scratch.table(e.repartition(1).mapInArrow(_local, "node bigint, root bigint"), "roots")
    e = scratch.table(e.distinct(), "distinct")
    before = _state(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, "large")
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        met = large.join(least, F.col("u") == F.col("x"))
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        new = scratch.table(small.distinct(), "small")
        scratch.drop(e, large)
        e, after = new, _state(new)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
