"""File records: tags, gates, duplicates, hashes and byte ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(tags: Column, only: Sequence[str] = (), never: Sequence[str] = ()) -> Column:
    """Whether a scan runs on a file: it has one of the tags in ``only`` (if any are named) and none of ``never``.

    Null tags count as none."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    some = lambda xs: F.arrays_overlap(own, F.array(*[F.lit(x) for x in xs]))
    wanted = some(only) if only else F.lit(True)
    return wanted & ~some(never) if never else wanted


def markers_first(files: DataFrame, offsets: DataFrame, corrections: dict[str, int], wanted: Sequence[str]) -> DataFrame:
    """Files in which one of the ``wanted`` markers was found, with the markers in the order in which to try them:
    those that lie at the start of the file, corrected for where the marker lies in its format, come first."""
    table = F.create_map(*[F.lit(x) for kv in corrections.items() for x in kv]) if corrections else None
    shift = F.coalesce(table[F.col("marker")], F.lit(0)) if table is not None else F.lit(0)
    own = offsets.where(F.col("marker").isin(list(wanted))).groupBy("key", "marker").agg(F.min("offset").alias("offset"))
    own = own.withColumn("at_start", (F.col("offset") - shift) == 0)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at_start"), "offset", "marker"))
    return files.join(own.withColumn("place", place), "key")


def first_of_each(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``duplicate``: false for the first row of each key in ``order``, true for the others.

    Null keys are no duplicates of each other. The order replaces a race between writers; put the preference for an
    original (say, a library under its own name) in front of the path."""
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    out = df.join(least, key, "left")
    return out.withColumn("duplicate", F.coalesce(F.struct(*order) != F.col("__first"), F.lit(False))).select(*df.columns, "duplicate")


def duplicate_groups(df: DataFrame, key: str, path: str) -> DataFrame:
    """(key, path, group_size) of all distinct paths of keys that have more than one: the groups, a row per member."""
    own = df.select(key, path).dropna().distinct()
    sizes = own.groupBy(key).agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return own.join(sizes, key)


def hashes(content: Column) -> list[Column]:
    """md5, sha1, sha256 and crc32 of a content."""
    return [F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"), F.crc32(content).alias("crc32")]


def inside_ranges(points: DataFrame, ranges: DataFrame, *, width: int) -> DataFrame:
    """Points (key, x) with ``until``: the greatest end of the ranges (key, lo, hi) with lo <= x < hi, null outside.

    Ranges are cut into bins of ``width`` and meet only the points of their bins; ranges of one bin that another one
    of the same bin covers are left out before."""
    bins = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    r = ranges.where("hi > lo").select("key", "lo", "hi", bins.alias("bin")).groupBy("key", "bin", "lo").agg(F.max("hi").alias("hi"))
    p = points.withColumn("bin", F.floor(F.col("x") / width))
    on = (p["key"] == r["key"]) & (p["bin"] == r["bin"]) & (r["lo"] <= p["x"]) & (p["x"] < r["hi"])
    return p.join(r, on, "left").groupBy(*[p[c] for c in points.columns]).agg(F.max(r["hi"]).alias("until"))


def next_range(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points (key, x) with ``start``: the start of the next range (key, lo) behind x, 0 if there is none.

    Points and starts are put into one order per key, so no point meets more than one start."""
    both = points.select("key", F.col("x").alias("at"), F.lit(1).alias("kind")).unionByName(ranges.select("key", F.col("lo").alias("at"), F.lit(0).alias("kind")))
    behind = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    start = F.first(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(behind)
    return both.withColumn("start", F.coalesce(start, F.lit(0))).where("kind = 1").select("key", F.col("at").alias("x"), "start")


def next_trailer(headers: DataFrame, trailers: DataFrame) -> DataFrame:
    """(key, header, trailer): each header offset (key, offset) with the first trailer (key, offset) at or behind it;
    headers without one are left out."""
    both = headers.select("key", "offset", F.lit(0).alias("kind")).unionByName(trailers.select("key", "offset", F.lit(1).alias("kind")))
    behind = Window.partitionBy("key").orderBy("offset", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    trailer = F.first(F.when(F.col("kind") == 1, F.col("offset")), ignorenulls=True).over(behind)
    return both.withColumn("trailer", trailer).where("kind = 0 and trailer is not null").select("key", F.col("offset").alias("header"), "trailer")


def tag_statistics(files: DataFrame) -> DataFrame:
    """(tag, n, bytes): files and their sizes by tag."""
    return files.select(F.explode("tags").alias("tag"), "size").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def gaps(ranges: DataFrame) -> DataFrame:
    """(key, lo, hi) of what lies between the claimed ranges (key, lo, hi) of each file."""
    before = F.max("hi").over(Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("__end", before).where(F.col("__end") < F.col("lo")).select("key", F.col("__end").alias("lo"), F.col("lo").alias("hi"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def without_root(path: Column, package: Column, version: Column) -> Column:
    """A path without its first directory where that is the package and its version, joined by - or _, once marks of
    repackaging are taken off."""
    root = F.regexp_replace(F.element_at(F.split(path, "/"), 1), r"[+~]dfsg$|\.orig$|\.dfsg[12]$", "")
    plain = F.regexp_replace(version, r"[+~]dfsg$|\.orig$|\.dfsg[12]$", "")
    own = (root == F.concat(package, F.lit("-"), plain)) | (root == F.concat(package, F.lit("_"), plain))
    return F.when(own & (F.instr(path, "/") > 0), F.regexp_replace(path, "^[^/]*/", "")).otherwise(path)


def ancestors(path: Column) -> Column:
    """All directories above a path, each with a slash behind it, and the path itself."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == F.size(parts), path).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    return F.array_distinct(above)
