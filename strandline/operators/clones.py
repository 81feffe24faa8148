"""Packages that contain other packages, copies of third parties, and comparison of trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contained(files: DataFrame) -> DataFrame:
    """(package, other, n_keys, n_other, clone): packages all of whose keys another package has as well.

    ``files`` has package and key. clone is ``identical`` when the other has no more keys, else ``partial``.
    Candidates are only the packages that hold the rarest key of a package, so a file that lies in all packages does
    not pair them all; the other keys are then counted for these candidates alone."""
    own = files.select("package", "key").dropna().distinct()
    sizes = own.groupBy("package").agg(F.count(F.lit(1)).alias("n_keys"))
    spread = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(spread, "key").groupBy("package").agg(F.min(F.struct("n", "key")).alias("r")).where("r.n > 1")
    pairs = rarest.select("package", F.col("r.key").alias("key")).join(own.withColumnRenamed("package", "other"), "key").where("package != other").select("package", "other")
    others = own.withColumnRenamed("package", "other")
    shared = pairs.join(own, "package").join(others, ["other", "key"]).groupBy("package", "other").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(sizes, "package").where("shared = n_keys").join(sizes.withColumnsRenamed({"package": "other", "n_keys": "n_other"}), "other")
    return out.select("package", "other", "n_keys", "n_other", F.when(F.col("n_keys") == F.col("n_other"), "identical").otherwise("partial").alias("clone"))


def third_party(files: DataFrame, markers: str, *, besides: Sequence[str] = ()) -> DataFrame:
    """Rows (row_id) of files that are copies of another package's: the other package has the same key, its name
    occurs in the directory, and so does one of the ``markers`` (a pattern). Packages ``besides`` are left out."""
    own = files.select("row_id", "package", "key", F.regexp_replace("pathname", "/?[^/]*$", "").alias("dir")).dropna()
    own = own.where(F.col("dir").rlike(markers) & ~F.col("package").isin(list(besides)))
    others = files.select(F.col("package").alias("other"), "key").dropna().distinct()
    return own.join(others, "key").where("package != other and instr(dir, other) > 0").select("row_id").distinct()


def compare_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, key, state) of the left (name, key): same, different or missing in the right tree (name, key)."""
    l_, r = left.select("name", "key").dropna().distinct(), right.select("name", "key").dropna().distinct()
    names = r.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    out = l_.join(r.withColumn("__same", F.lit(True)), ["name", "key"], "left").join(names, "name", "left")
    return out.select("name", "key", F.when(F.col("__same"), "same").when(F.col("n").isNotNull(), "different").otherwise("missing").alias("state"))


def merge_renamed(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows after a rename: of those that have come to have equal ``keys`` the one of the least ``order`` stays."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def new_rows(incoming: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming``, one per key, whose key is not yet present: what an append may add. Null keys are new."""
    return incoming.dropDuplicates(list(keys)).join(present.select(*keys).distinct(), list(keys), "left_anti")


def replaced(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with all rows of the groups in ``fresh`` (by ``keys``) replaced by the fresh ones."""
    return table.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)
