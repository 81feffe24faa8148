"""Joins and groupings that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import swept

#: A key is hot when it holds more than this share of the rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 64
SALT = "__salt"


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The values of ``key`` that hold more than ``share`` of the rows with a non-null key.

    The counts are combined on the map side, and at most ``1 / share`` values can pass the threshold, so what
    reaches the driver has a fixed bound at every size of input.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    with swept(df.sparkSession):
        totals = counts.agg(F.sum("__n").alias("t"), F.max("__n").alias("m")).first()
        if totals is None or totals["t"] is None or totals["m"] <= max(totals["t"] * share, 1):
            return []
        bound = max(int(totals["t"] * share), 1)
        return [r[0] for r in counts.where(F.col("__n") > bound).select(key).collect()]


def fan(df: DataFrame) -> int:
    """Parts into which the rows of a hot key are spread."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salted(df: DataFrame, key: str, hot: Sequence, by: Column, parts: int) -> DataFrame:
    """Adds the salt: for hot keys a part chosen by the hash of ``by``, else 0."""
    if not hot:
        return df.withColumn(SALT, F.lit(0))
    return df.withColumn(SALT, F.when(F.col(key).isin(list(hot)), F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).otherwise(F.lit(0)))


def replicated(df: DataFrame, key: str, hot: Sequence, parts: int) -> DataFrame:
    """Copies the rows of hot keys into every part; all other rows are left alone."""
    if not hot:
        return df.withColumn(SALT, F.lit(0))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    return df.withColumn(SALT, F.explode(F.when(F.col(key).isin(list(hot)), every).otherwise(F.array(F.lit(0)))))


def workers(df: DataFrame) -> int:
    """Parts for work that is heavy for its bytes, which the sizes of partitions would put into one task."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
