"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory that holds one Parquet file or folder per table."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
