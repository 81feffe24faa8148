"""The knowledge base: caches of identifiers by package, scores and averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import SALT, fan, hot_keys, replicated, salted

#: Base of the penalty for a string that lies in several files, and the score below which nothing is left of it.
ALPHA, LEAST_SCORE = 5.0, 1e-37


def identifier_cache(strings: DataFrame, files: DataFrame) -> DataFrame:
    """(language, line, package, filename), distinct: where each string literal occurs.

    ``strings`` has line, key (of the file) and language, ``files`` key, package and filename; rows with a null in
    any of them take no part. Both sides are made distinct before they meet, and the strings of hot files are spread.
    """
    s = strings.select("key", "language", "line").dropna().distinct()
    f = files.select("key", "package", "filename").dropna().distinct()
    hot, parts = hot_keys(s, "key"), fan(strings)
    met = salted(s, "key", hot, F.col("line"), parts).join(replicated(f, "key", hot, parts), ["key", SALT])
    return met.select("language", "line", "package", "filename").distinct()


def line_facts(cache: DataFrame) -> DataFrame:
    """Per (language, line): packages, filenames and pairs of them, and the least package.

    The cache is distinct, so each pair is one row. All counts come from one reading of it: the distinct counts are made of
    rows per (line, package) and (line, filename), which combine before the shuffle, so that no set of a common line is
    ever held."""
    one = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("package").alias("x")), F.struct(F.lit(1).alias("k"), F.col("filename").cast("string").alias("x"))))
    each = cache.select("language", "line", one.alias("o")).groupBy("language", "line", "o.k", "o.x").agg(F.count(F.lit(1)).alias("n"))
    package = F.col("k") == 0
    n = lambda c: F.count_if(c)
    return each.groupBy("language", "line").agg(F.sum(F.when(package, F.col("n"))).alias("n_pairs"), n(package).alias("n_packages"), F.min(F.when(package, F.col("x"))).alias("package"), n(~package).alias("n_filenames"))


def line_score(line: Column, n_packages: Column, n_filenames: Column) -> Column:
    """The whole length for a line of one package, else the length divided by ALPHA for each further file name."""
    shared = F.length(line) / F.pow(F.lit(ALPHA), n_filenames - 1)
    return F.when(n_packages == 1, F.length(line).cast("double")).when(shared < LEAST_SCORE, F.lit(0.0)).otherwise(shared)


def score_table(facts: DataFrame) -> DataFrame:
    """(language, line, packages, score)."""
    return facts.select("language", "line", F.col("n_packages").alias("packages"), line_score(F.col("line"), F.col("n_packages"), F.col("n_filenames")).alias("score"))


def average_strings(strings: DataFrame, files: DataFrame) -> DataFrame:
    """(language, package, avgstrings): distinct strings of each version, averaged over the versions with any."""
    s = strings.select("key", "language", "line").dropna().distinct()
    f = files.select("key", "package", "version").dropna().distinct()
    hot, parts = hot_keys(s, "key"), fan(strings)
    met = salted(s, "key", hot, F.col("line"), parts).join(replicated(f, "key", hot, parts), ["key", SALT])
    each = met.select("language", "package", "version", "line").distinct()
    return each.groupBy("language", "package", "version").agg(F.count(F.lit(1)).alias("n")).groupBy("language", "package").agg((F.sum("n") / F.count(F.lit(1))).alias("avgstrings"))


def aliased(df: DataFrame, renames: DataFrame, column: str = "package") -> DataFrame:
    """``df`` with old names in ``column`` replaced; of several renames of a name that of the least row_id holds,
    and a null new name changes nothing. ``renames`` has row_id, originalname and newname."""
    first = renames.where("originalname is not null").groupBy("originalname").agg(F.min_by("newname", "row_id").alias("__new"))
    out = df.join(first, F.col(column) == F.col("originalname"), "left")
    return out.withColumn(column, F.coalesce("__new", column)).select(*df.columns)
