"""Scratch tables and size checks."""

from __future__ import annotations

import os

from orthoflow.staging import Scratch, rows, scratch_root, small_side, spread


def test_tables_live_in_the_shared_folder(spark):
    scratch = Scratch(spark, "t")
    df = spark.range(10).toDF("a")
    table = scratch.table(df, "numbers")
    assert table._scratch_path.startswith(scratch_root(spark) + "/t-")
    assert rows(table) == 10 and sorted(r["a"] for r in table.collect()) == list(range(10))
    local = table._scratch_path.removeprefix("file://")
    assert os.path.isdir(local)
    scratch.drop(table, None)
    assert not os.path.exists(local)


def test_empty_tables_keep_their_schema(spark):
    empty = Scratch(spark, "t").table(spark.createDataFrame([], "a int, b string"), "none")
    assert empty.dtypes == [("a", "int"), ("b", "string")]
    assert rows(empty) == empty.count() == 0


def test_runs_do_not_share_paths(spark):
    assert Scratch(spark, "t").path != Scratch(spark, "t").path


def test_broadcast_only_within_the_bound(spark):
    table = Scratch(spark, "t").table(spark.range(100).toDF("a"), "n")

    def hinted(limit):
        plan = spark.range(100).toDF("a").join(small_side(table, 8, limit), "a")
        return "strategy=broadcast" in plan._jdf.queryExecution().logical().toString()

    assert hinted(800)
    assert not hinted(799)


def test_spread(spark):
    one = spark.range(5).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(9)
    assert spread(many) is many
