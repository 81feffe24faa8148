"""The tables as the operators want them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import checksum_key
from strandline.sources import table


def strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_string").select("row_id", checksum_key(F.col("checksum")).alias("key"), F.col("stringidentifier").alias("line"), "language", "linenumber")


def functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_function").select(checksum_key(F.col("checksum")).alias("key"), F.col("functionname").alias("name"), "language", "linenumber")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed_file").select("row_id", "package", "version", "pathname", checksum_key(F.col("checksum")).alias("key"), "filename", "thirdparty")


def contents(spark: SparkSession, d: str) -> DataFrame:
    """Files in RPMs: the unknown binaries that are matched with the knowledge base, one per RPM."""
    t = table(spark, d, "rpm_contents")
    return t.select("row_id", F.lower(F.trim("rpmchecksum")).alias("container"), checksum_key(F.col("checksum")).alias("key"), "filename", "type")


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """(container, language, line, ordinal): the string literals of the files in each RPM."""
    inside = contents(spark, d).select("container", "key").dropna().distinct()
    own = table(spark, d, "extracted_string").select("row_id", checksum_key(F.col("checksum")).alias("key"), F.col("stringidentifier").alias("line"), "language")
    return own.join(inside, "key").select("container", "language", "line", F.col("row_id").alias("ordinal"))


#: Common table expressions of the same names; ck is the comparable checksum.
SQL = """
es AS (SELECT row_id, lower(trim(checksum, ' ')) AS ck, stringidentifier AS line, language, linenumber FROM extracted_string),
ef AS (SELECT row_id, lower(trim(checksum, ' ')) AS ck, functionname AS name, language, linenumber FROM extracted_function),
pf AS (SELECT row_id, package, version, pathname, lower(trim(checksum, ' ')) AS ck, filename, thirdparty FROM processed_file),
rc AS (SELECT row_id, lower(trim(rpmchecksum, ' ')) AS container, lower(trim(checksum, ' ')) AS ck, filename, type FROM rpm_contents),
ids AS (SELECT container, language, line, es.row_id AS ordinal FROM (SELECT DISTINCT container, ck FROM rc WHERE container IS NOT NULL AND ck IS NOT NULL) JOIN es USING (ck)),
cache AS (SELECT DISTINCT language, line, package, filename FROM es JOIN pf USING (ck)
  WHERE language IS NOT NULL AND line IS NOT NULL AND package IS NOT NULL AND filename IS NOT NULL),
facts AS (SELECT language, line, count(*) AS n_pairs, count(DISTINCT package) AS n_packages, count(DISTINCT filename) AS n_filenames, min(package) AS package FROM cache GROUP BY ALL),
lines AS (SELECT container, language, line, count(*) AS n FROM ids WHERE line IS NOT NULL AND line <> '' AND language IS NOT NULL GROUP BY ALL),
classified AS (SELECT l.*, f.n_packages, f.n_filenames, f.package,
  CASE WHEN length(line) < 5 THEN 'ignored' WHEN n_packages IS NULL THEN 'unmatched' WHEN n_packages = 1 THEN 'unique'
    WHEN length(line) / pow(5.0, n_filenames - 1) <= 1e-20 THEN 'nonassigned' WHEN n_pairs = n_filenames THEN 'notclone' ELSE 'cloned' END AS class,
  length(line) / pow(5.0, n_filenames - 1) AS shared FROM lines l LEFT JOIN facts f USING (language, line))
"""


def with_base(query: str) -> str:
    return f"WITH RECURSIVE {SQL} {query}"
