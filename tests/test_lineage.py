"""Stored tables have an owner."""

import os

from pyspark.sql import functions as F

from graphrank.plans.lineage import Workspace, materialize


def folders(spark):
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {d for d in os.listdir(base) if d.startswith("stored-")}


def test_tables_go_with_their_workspace(spark, frame):
    outside = materialize(frame([(1,)], "a int"))
    before = folders(spark)
    with Workspace(spark) as outer:
        first = materialize(frame([(2,)], "a int"))
        with Workspace(spark):
            materialize(frame([(3,)], "a int"))
        assert len(folders(spark) - before) == 1
        with Workspace(spark) as inner:
            step = materialize(frame([(4,), (5,)], "a int"))
            result = inner.hand_on(step.where("a > 4"))
        assert [r["a"] for r in result.collect()] == [5] and first.count() == 1
        last = outer.hand_on(result)
    assert [r["a"] for r in last.collect()] == [5] and outside.count() == 1
    assert len(folders(spark) - before) == 1  # the one that was handed on to nobody


def test_a_stored_table_leaves_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    for _ in range(5):
        rows = spark.range(1000).repartition(8).groupBy((F.col("id") % 10).alias("k")).count()
        assert materialize(rows).where("k < 0").collect() == []
    assert files.getAllFiles().size() - before < 5
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
