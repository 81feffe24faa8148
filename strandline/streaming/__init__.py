"""Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the time that rows may come late; the state is bounded by that time."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, by: str, at: str, *, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, by, n, total): rows and sum of ``value`` per window of time and value of ``by``."""
    own = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by)
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, by: str, at: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, start, end, n): stretches of activity of each ``by`` without a pause longer than ``gap``."""
    own = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by)
    return own.agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into a Parquet table and stop. In ``complete`` mode each batch replaces the table."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
    else:
        writer = writer.format("parquet").option("path", target)
    writer.start().awaitTermination()
