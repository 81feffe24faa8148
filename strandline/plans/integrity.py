"""Queries p1 (orphan references) and p6 (keys that hold most rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import checksum_key
from strandline.operators.hotkeys import heavy_keys, key_profile
from strandline.operators.orphans import MATCHES, Validity, orphan_report, orphans
from strandline.sources import table

#: referring table, its key, target table, its key
REFERENCES = (
    ("extracted_string", "checksum", "processed_file", "checksum"),
    ("processed_file", "checksum", "source_head", "checksum"),
    ("rpm_contents", "rpmchecksum", "rpm", "checksum"),
)


def _orphans(spark: SparkSession, d: str, reason: str | None = None) -> DataFrame:
    found = []
    for name, key, target, target_key in REFERENCES:
        refs = table(spark, d, name).select("row_id", "loaded_at", checksum_key(F.col(key)).alias("reference"))
        to = table(spark, d, target).select(checksum_key(F.col(target_key)).alias("target"), "loaded_at", "removed_at")
        own = orphans(refs, to, [("reference", "target")], validity=Validity("loaded_at", "loaded_at", "removed_at"), reason=reason)
        found.append(own.select(F.lit(name).alias("table_name"), "row_id", "loaded_at", *([reason] if reason else [])))
    return reduce(DataFrame.unionByName, found)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphan_report(_orphans(spark, d, "reason"), "table_name", "loaded_at", "reason")


def p1_composite(spark: SparkSession, d: str) -> DataFrame:
    """Contents of RPMs by (filename, checksum) to the files of packages, whose keys are partly null, under each match."""
    own = lambda t: table(spark, d, t).select("row_id", "filename", checksum_key(F.col("checksum")).alias("key"))
    refs, to = own("rpm_contents"), own("processed_file")
    found = [orphans(refs, to, [("filename", "filename"), ("key", "key")], match=m, reason="reason").select(F.lit(m).alias("match"), "row_id", "reason") for m in MATCHES]
    return reduce(DataFrame.unionByName, found)


def _profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_string").select("stringidentifier", checksum_key(F.col("checksum")).alias("checksum"), "loaded_at")
    return key_profile(rows, "stringidentifier", "checksum", "loaded_at")


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_string").where("stringidentifier is not null").count()
    return heavy_keys(_profile(spark, d), "stringidentifier", rows, 100).select("stringidentifier")


_P1 = """
SELECT '{t}' AS table_name, r.row_id, r.loaded_at FROM {t} r
WHERE r.{k} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {to} t WHERE lower(trim(t.{tk}, ' ')) = lower(trim(r.{k}, ' '))
  AND t.loaded_at <= r.loaded_at AND (t.removed_at IS NULL OR t.removed_at > r.loaded_at))
"""
_P1_ALL = " UNION ALL ".join(_P1.format(t=t, k=k, to=to, tk=tk) for t, k, to, tk in REFERENCES)

_P1_REASON = _P1.replace("r.loaded_at FROM", """r.loaded_at,
  CASE WHEN NOT EXISTS (SELECT 1 FROM {to} t WHERE lower(trim(t.{tk}, ' ')) = lower(trim(r.{k}, ' ')) AND (t.removed_at IS NULL OR t.removed_at > t.loaded_at)) THEN 'missing'
  WHEN NOT EXISTS (SELECT 1 FROM {to} t WHERE lower(trim(t.{tk}, ' ')) = lower(trim(r.{k}, ' ')) AND (t.removed_at IS NULL OR t.removed_at > t.loaded_at) AND t.loaded_at <= r.loaded_at) THEN 'late'
  ELSE 'deleted' END AS reason FROM""")
_P1_REASONS = " UNION ALL ".join(_P1_REASON.format(t=t, k=k, to=to, tk=tk) for t, k, to, tk in REFERENCES)
_P1_COMPOSITE = """
WITH r AS (SELECT row_id, filename AS f, lower(trim(checksum, ' ')) AS c FROM rpm_contents),
t AS (SELECT DISTINCT filename AS f, lower(trim(checksum, ' ')) AS c FROM processed_file)
SELECT 'simple' AS match, row_id, 'missing' AS reason FROM r WHERE f IS NOT NULL AND c IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.f = r.f AND t.c = r.c)
UNION ALL SELECT 'full', row_id, CASE WHEN f IS NULL OR c IS NULL THEN 'incomplete' ELSE 'missing' END FROM r
  WHERE (f IS NOT NULL OR c IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM t WHERE t.f = r.f AND t.c = r.c)
UNION ALL SELECT 'partial', row_id, 'missing' FROM r WHERE (f IS NOT NULL OR c IS NOT NULL)
  AND CASE WHEN f IS NULL THEN c NOT IN (SELECT c FROM t WHERE c IS NOT NULL) WHEN c IS NULL THEN f NOT IN (SELECT f FROM t WHERE f IS NOT NULL)
    ELSE NOT EXISTS (SELECT 1 FROM t WHERE t.f = r.f AND t.c = r.c) END
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_reasons, p1_composite, p6_found, p6_profile)}
SQL = {
    "p1_found": f"SELECT table_name, row_id FROM ({_P1_ALL})",
    "p1_report": f"SELECT table_name, strftime(loaded_at, '%Y-%m') AS month, count(*) AS orphans FROM ({_P1_ALL}) GROUP BY ALL",
    "p1_reasons": f"SELECT table_name, strftime(loaded_at, '%Y-%m') AS month, reason, count(*) AS orphans FROM ({_P1_REASONS}) GROUP BY ALL",
    "p1_composite": _P1_COMPOSITE,
    "p6_found": """SELECT stringidentifier FROM extracted_string WHERE stringidentifier IS NOT NULL GROUP BY 1
        HAVING count(*) * 100 >= (SELECT count(stringidentifier) FROM extracted_string)""",
    "p6_profile": """SELECT stringidentifier, count(*) AS n_rows, count(DISTINCT lower(trim(checksum, ' '))) AS n_records,
        min(loaded_at) AS first_at, quantile_disc(loaded_at, 0.5) AS at_50
        FROM extracted_string WHERE stringidentifier IS NOT NULL GROUP BY 1""",
}
