"""Intermediate tables in the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A side is broadcast only when its row count times its row width is within this many bytes.
BROADCAST_BYTES = 32 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="orthoflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one run, below the shared folder.

    Every table gets a path of its own, so a rerun never reads another run's files. `drop` removes tables that
    nothing reads any more; the rest goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        self._fs(self.path, "deleteOnExit")

    def _fs(self, path: str, call: str, *args):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return getattr(fs, call)(p, *args)

    def mkdirs(self, name: str) -> str:
        path = f"{self.path}/{name}"
        self._fs(path, "mkdirs")
        return path

    def table(self, df: DataFrame, name: str, row_bytes: Column | None = None) -> DataFrame:
        """Write `df` and read it back: cuts the lineage, as checkpoint() does, and keeps file statistics.

        Its rows are counted on the way, for `rows`; with `row_bytes`, the size of a row, their bytes too, for `small_side`.
        """
        self._count += 1
        path = f"{self.path}/{self._count:03d}-{name}"
        # zstd: the snappy writer keeps direct buffers until a garbage collection, which adds up over many files
        seen = Observation()
        size = F.coalesce(F.sum((F.lit(0) if row_bytes is None else row_bytes).cast("bigint")), F.lit(0))
        df.observe(seen, F.count(F.lit(1)).alias("n"), size.alias("bytes")).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        out._scratch_rows = seen.get.get("n")
        out._scratch_bytes = None if row_bytes is None else seen.get.get("bytes")
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_scratch_path", None):
                self._fs(t._scratch_path, "delete", True)


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table of given rows as a local relation: its size is known, so Spark broadcasts it, and no job reads it."""
    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=kind.names), kind)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out over all cores if it comes in fewer splits than those, as small tables do; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rows(df: DataFrame) -> int:
    """How many rows `df` has: known for a scratch table, counted for any other."""
    known = getattr(df, "_scratch_rows", None)
    return df.count() if known is None else known


def small_side(df: DataFrame, row_bytes: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, a scratch table, marked for broadcast if it is within `limit` bytes, else with a merge hint.

    `row_bytes` is the size of a row where all are alike; without it the table must have been written with the sizes of its rows.
    """
    size = df._scratch_bytes if row_bytes is None else rows(df) * row_bytes
    return F.broadcast(df) if size <= limit else df.hint("merge")
