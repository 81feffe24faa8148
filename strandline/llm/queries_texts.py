"""Queries p8 (ids of every text), p9 (a mix of the sources by target weights) and p10 (long common spans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.mixing import mix
from strandline.llm.spans import class_links, class_sizes, document_pairs, passages, repeated_sentences, shared_spans, shares
from strandline.llm.tokenize import encode_texts, text_sizes
from strandline.sources import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents").select("doc_id", "text"), "text")


def p8_sizes(spark: SparkSession, d: str) -> DataFrame:
    return text_sizes(table(spark, d, "documents").select("doc_id", "text"), "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = text_sizes(table(spark, d, "documents").select("doc_id", "source", "text"), "text")
    return mix(sizes, table(spark, d, "mix_target"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    classes, members = shared_spans(table(spark, d, "documents"))
    return document_pairs(classes, class_links(members))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    classes, members = shared_spans(table(spark, d, "documents"))
    return class_sizes(classes, class_links(members))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return passages(*shared_spans(docs), docs)


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d)


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(_passages(spark, d), table(spark, d, "documents"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return repeated_sentences(_passages(spark, d), table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p8_ids, p8_sizes, p9_mix, p9_report, p10_found, p10_classes, p10_passages, p10_shares, p10_sentences)}
#: Neither a tokenizer nor the choice by hash can be said in SQL; see tests/llm.
_P10 = """
WITH w AS (SELECT doc_id, i - 1 AS i, md5(substr(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
g AS (SELECT h, min(doc_id) AS least, max(doc_id) AS most FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT doc_id, i, least FROM w JOIN g USING (h)),
k AS (SELECT doc_id, 'shared' AS kind, i FROM r UNION ALL SELECT doc_id, 'repeated', i FROM r WHERE least < doc_id),
s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, kind ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM k),
t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY i) AS part FROM s),
p AS (SELECT doc_id, kind, min(i) AS "from", max(i) + 200 AS "to" FROM t GROUP BY doc_id, kind, part)
"""
SQL = {
    "p10_found": """
WITH g AS (SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_classes": """
WITH c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE length(text) >= 200),
g AS (SELECT DISTINCT class_id, md5(substr(text, i, 200)) AS h FROM (SELECT class_id, text, unnest(range(1, length(text) - 198)) AS i FROM c WHERE doc_id = class_id)),
l AS (SELECT a.class_id, count(DISTINCT b.class_id) AS links FROM g a JOIN g b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY 1)
SELECT doc_id, class_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (class_id)""",
    "p10_passages": f"{_P10} SELECT * FROM p",
    "p10_shares": f"""{_P10}, n AS (SELECT doc_id, sum(CASE WHEN kind = 'shared' THEN "to" - "from" ELSE 0 END) AS a, sum(CASE WHEN kind = 'repeated' THEN "to" - "from" ELSE 0 END) AS b FROM p GROUP BY 1)
SELECT doc_id, length(text) AS n_chars, CASE WHEN text IS NOT NULL THEN coalesce(a, 0)::BIGINT END AS shared_chars, CASE WHEN text IS NOT NULL THEN coalesce(b, 0)::BIGINT END AS repeated_chars
FROM documents LEFT JOIN n USING (doc_id)""",
}
