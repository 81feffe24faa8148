"""Queries p3 (garbled text), p4 (files that are not hand-written) and p7 (names mapped to a reference)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import checksum_key
from strandline.llm.canonical import map_names
from strandline.llm.handwritten import not_handwritten
from strandline.llm.mojibake import garbled_rows
from strandline.sources import table

_TEXTS = (("extracted_string", "stringidentifier"), ("extracted_function", "functionname"))
_NAMES = (("processed", "package"), ("renames", "originalname"), ("renames", "newname"))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("table_name"), "row_id", F.col(c).alias("value")) for t, c in _TEXTS]
    return garbled_rows(reduce(DataFrame.unionByName, parts), "value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_restored(spark, d).select("table_name", "row_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "processed_file").withColumn("key", checksum_key(F.col("checksum")))
    heads = table(spark, d, "source_head").select(checksum_key(F.col("checksum")).alias("key"), "head")
    return not_handwritten(files, heads)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_kinds(spark, d).select("row_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(f"{t}.{c}").alias("field"), "row_id", F.col(c).alias("name")).where("name is not null") for t, c in _NAMES]
    reference = table(spark, d, "canonical_package").select(F.col("package_id").alias("entry_id"), F.col("package").alias("entry"))
    renames = table(spark, d, "renames").select("row_id", F.col("originalname").alias("old"), F.col("newname").alias("new"))
    found = map_names(reduce(DataFrame.unionByName, parts), "name", reference, renames)
    return found.select("field", "row_id", F.col("entry_id").alias("package_id"))


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Names without an entry, with their number of rows."""
    parts = [table(spark, d, t).select(F.lit(f"{t}.{c}").alias("field"), "row_id", F.col(c).alias("name")).where("name is not null") for t, c in _NAMES]
    found = p7_found(spark, d).where("package_id = 0")
    return reduce(DataFrame.unionByName, parts).join(found, ["field", "row_id"], "left_semi").groupBy("field", "name").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (p3_found, p3_restored, p4_found, p4_kinds, p7_found, p7_unmatched)}
SQL: dict[str, str] = {}
