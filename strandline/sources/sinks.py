"""Writers of facts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.clones import new_rows


def append_facts(df: DataFrame, path: str, by: Sequence[str] = ("language",)) -> None:
    """Append facts, partitioned so that a reader of one language skips the others."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append only rows whose key is not there yet; doing it twice adds nothing."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        df.dropDuplicates(list(keys)).write.parquet(path)
        return
    # Only the key columns of what is there are read.
    new_rows(df, spark.read.parquet(path), keys).write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows of, and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_reports(df: DataFrame, path: str) -> None:
    """One JSON document per row, compressed."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def with_hashes(report: DataFrame, conversion: DataFrame, kind: str) -> DataFrame:
    """Checksums of a report as another kind of hash where it is known, else as they are; ``conversion`` has sha256
    and one column per kind."""
    table = conversion.select(F.col("sha256").alias("checksum"), F.col(kind).alias("__other")).dropDuplicates(["checksum"])
    return report.join(table, "checksum", "left").withColumn("checksum", F.coalesce("__other", "checksum")).select(*report.columns)
