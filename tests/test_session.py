"""Lineage cuts and their removal."""

import glob
import os
import time

from strandline.session import cut, drop, release, scratch


def test_cut_and_release(spark):
    df = cut(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    assert sorted(map(tuple, df.collect())) == [(1, "a"), (2, None)]
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    other = scratch(spark, "other").removeprefix("file:")
    assert os.path.isdir(path) and not os.path.exists(other)
    release(spark)
    assert not os.path.exists(path)
    release(spark)


def test_cut_of_an_empty_table(spark):
    df = cut(spark.createDataFrame([], "k int, v string"))
    assert df.count() == 0 and df.columns == ["k", "v"]


def test_cut_leaves_no_shuffle_and_drop_no_table(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for d in manager.localDirs() for f in glob.glob(f"{d}/*/shuffle_*")}
    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = cut(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    for _ in range(100):
        if left := shuffled() - before:
            time.sleep(0.1)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 7 and os.path.isdir(path)
    drop(df)
    assert not os.path.exists(path)
