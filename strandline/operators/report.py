"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_others(ranked: DataFrame, *, upto: float = 98.0, least: float = 0.5) -> DataFrame:
    """(container, package, share): packages in rank order until their shares reach ``upto`` percent or one falls
    below ``least``; the rest under the name others."""
    before = F.coalesce(F.sum("share").over(Window.partitionBy("container").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    named = (F.col("before") < upto) & (F.col("share") >= least)
    name = F.when(named, F.col("package")).otherwise(F.lit("others"))
    return ranked.withColumn("before", before).groupBy("container", name.alias("package")).agg(F.sum("share").alias("share"))


def squashed_versions(df: DataFrame, group: list[str], version: str = "version") -> DataFrame:
    """(group..., prefix, versions): versions that differ only in their last part, as prefix.{a, b}; a single one
    stays as it is."""
    last = F.regexp_extract(version, r"([^.]*)$", 1)
    head = F.regexp_replace(version, r"\.?[^.]*$", "")
    own = df.select(*group, head.alias("prefix"), last.alias("last")).distinct()
    lists = own.groupBy(*group, "prefix").agg(F.array_sort(F.collect_set("last")).alias("l"))
    dot = F.when(F.col("prefix") == "", F.lit("")).otherwise(F.concat("prefix", F.lit(".")))
    text = F.when(F.size("l") == 1, F.concat(dot, F.element_at("l", 1))).otherwise(F.concat(dot, F.lit("{"), F.array_join("l", ", "), F.lit("}")))
    return lists.select(*group, "prefix", text.alias("versions"))


def nested(ranked: DataFrame, unique: DataFrame, versions: DataFrame) -> DataFrame:
    """(container, report): one JSON report per container with its packages, their unique lines and versions.

    Nested from the inside out, each level one grouping; a report is one document of one container by its nature."""
    lines = unique.groupBy("container", "package").agg(F.array_sort(F.collect_list(F.struct("line", "n"))).alias("unique"))
    vs = versions.groupBy("container", "package").agg(F.array_sort(F.collect_list(F.struct("version", "n_lines"))).alias("versions"))
    both = ranked.join(lines, ["container", "package"], "left").join(vs, ["container", "package"], "left")
    packages = F.array_sort(F.collect_list(F.struct("rank", "package", "score", "share", "unique", "versions")))
    return both.groupBy("container").agg(F.to_json(F.struct(packages.alias("reports"))).alias("report"))
