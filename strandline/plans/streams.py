"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import streaming
from strandline.session import scratch
from strandline.sources import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _ran(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    at = scratch(spark, "stream")
    streaming.run_once(stream, f"{at}/out", f"{at}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.concat_ws("/", "user_id", "event_type").alias("key"), "ts", "event_id")
    return _ran(spark, streaming.first_seen(rows, "key", "ts", "1 day")).select("key")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    out = _ran(spark, streaming.counts_by_window(_events(spark, d), "event_type", "ts"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_first_seen, stream_windows)}
SQL = {
    "stream_first_seen": "SELECT DISTINCT concat_ws('/', user_id, event_type) AS key FROM events",
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
