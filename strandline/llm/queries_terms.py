"""Queries p2 (frequency of every term) and p5 (how distinctive a term is)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import checksum_key, checksum_of_key
from strandline.llm.distinctive import term_weights
from strandline.llm.term_counts import mark, pair_counts
from strandline.sources import table

#: A string is common in more than one in COMMON_ONE_IN of all checksums, a checksum with more than COMMON_RECORDS strings.
COMMON_ONE_IN, COMMON_RECORDS = 50, 50


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_string").select("stringidentifier", checksum_key(F.col("checksum")).alias("key"))
    records = rows.select("key").where("key is not null").distinct().count()
    counts = pair_counts(rows, F.col("stringidentifier").cast("binary"), F.col("key"))
    strings = F.col("field") == 0
    common = F.when(strings, F.col("records") * COMMON_ONE_IN > F.lit(records)).otherwise(F.col("records") > COMMON_RECORDS)
    term = F.when(strings, F.decode("term", "utf-8")).otherwise(checksum_of_key(F.col("term")))
    return mark(counts, common).select(F.when(strings, "stringidentifier").otherwise("checksum").alias("field"), term.alias("term"), "occurrences", "records", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    owned = table(spark, d, "processed_file").select(F.col("package").alias("owner"), checksum_key(F.col("checksum")).alias("file"))
    held = table(spark, d, "extracted_string").select(checksum_key(F.col("checksum")).alias("file"), F.col("stringidentifier").alias("term"))
    out = term_weights(owned, held).withColumnsRenamed({"owner": "package", "term": "stringidentifier"})
    return out.withColumn("weight", F.round("weight", 6) + 0.0)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "scores").select("stringidentifier").distinct()
    distinctive = F.col("n_pair") * F.col("n_files") >= 3 * F.col("n_term") * F.col("n_owner")
    return p5_weights(spark, d).where((F.col("n_pair") >= 3) & distinctive).join(known, "stringidentifier", "left_semi").select("package", "stringidentifier")


_P2 = """
WITH r AS (SELECT stringidentifier AS s, lower(trim(checksum, ' ')) AS c FROM extracted_string),
a AS (SELECT 'stringidentifier' AS field, s AS term, count(*) AS occurrences, count(DISTINCT c) AS records FROM r WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY s
  UNION ALL SELECT 'checksum', c, count(*), count(DISTINCT s) FROM r WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY c)
SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN field = 'checksum' AND records > 50 THEN 'common'
  WHEN field = 'stringidentifier' AND records * 50 > (SELECT count(DISTINCT c) FROM r) THEN 'common' END AS mark FROM a
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p5_found, p5_weights)}
_P5 = """
WITH o AS (SELECT DISTINCT package, lower(trim(checksum, ' ')) AS f FROM processed_file WHERE package IS NOT NULL AND checksum IS NOT NULL),
h AS (SELECT DISTINCT lower(trim(checksum, ' ')) AS f, stringidentifier FROM extracted_string WHERE checksum IS NOT NULL AND stringidentifier IS NOT NULL),
sp AS (SELECT package, stringidentifier, count(*) AS n_pair FROM o JOIN h USING (f) GROUP BY ALL),
s AS (SELECT stringidentifier, count(DISTINCT f) AS n_term FROM h WHERE f IN (SELECT f FROM o) GROUP BY ALL),
c AS (SELECT stringidentifier, sum(n_pair)::DOUBLE AS cf, count(*) AS owners FROM sp GROUP BY ALL),
p AS (SELECT package, count(*) AS n_owner FROM o GROUP BY ALL),
n AS (SELECT count(DISTINCT f) AS n_files, count(DISTINCT package)::DOUBLE AS d FROM o)
SELECT package, stringidentifier, n_pair, n_term, n_owner, n_files, owners,
  n_pair * (log2(1 - exp(-cf / d)) - log2(owners / d)) AS weight
FROM sp JOIN s USING (stringidentifier) JOIN c USING (stringidentifier) JOIN p USING (package), n
"""
SQL = {"p5_weights": _P5.replace("n_pair * (log2", "round(n_pair * (log2").replace("d)) AS weight", "d)), 6) + 0.0 AS weight"), "p5_found": f"""SELECT package, stringidentifier FROM ({_P5})
  WHERE n_pair >= 3 AND n_pair * n_files >= 3 * n_term * n_owner AND stringidentifier IN (SELECT stringidentifier FROM scores)""", "p2_terms": _P2, "p2_found": f"SELECT field, term, mark FROM ({_P2}) WHERE mark IS NOT NULL"}
