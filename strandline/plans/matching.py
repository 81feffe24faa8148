"""Queries of the knowledge base, matching, ranking and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import attribute as A
from strandline.operators import knowledge as K
from strandline.operators import match as M
from strandline.plans import base as B
from strandline.plans.base import with_base
from strandline.session import cut
from strandline.sources import table


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return K.identifier_cache(B.strings(spark, d), B.files(spark, d))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return M.classify(M.lines_of(B.identifiers(spark, d)), _cache(spark, d))


def _materials(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cache and classified lines, written once for queries that read them more than once."""
    cache = cut(_cache(spark, d))
    return cache, cut(M.classify(M.lines_of(B.identifiers(spark, d)), cache))


def kb_identifier_cache(spark: SparkSession, d: str) -> DataFrame:
    return _cache(spark, d)


def score_table(spark: SparkSession, d: str) -> DataFrame:
    return K.score_table(K.line_facts(_cache(spark, d))).withColumn("score", F.round("score", 6))


def avgstrings(spark: SparkSession, d: str) -> DataFrame:
    return K.average_strings(B.strings(spark, d), B.files(spark, d)).withColumn("avgstrings", F.round("avgstrings", 6))


def alias_rewrite(spark: SparkSession, d: str) -> DataFrame:
    out = K.aliased(table(spark, d, "processed").select("row_id", "package"), table(spark, d, "renames"))
    return out.where("package is not null").groupBy("package").agg(F.count(F.lit(1)).alias("n"))


def match_counters(spark: SparkSession, d: str) -> DataFrame:
    return M.counters(_classified(spark, d))


def match_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("container", "language", "line", "n", "class")


def unmatched_strings(spark: SparkSession, d: str) -> DataFrame:
    lines = M.lines_of(B.identifiers(spark, d)).where("not ignored")
    return lines.join(_cache(spark, d), ["language", "line"], "left_anti").select("container", "language", "line", "n")


def ignored_strings(spark: SparkSession, d: str) -> DataFrame:
    return M.lines_of(B.identifiers(spark, d), cutoff=12).where("ignored").select("container", "language", "line", "n")


def _of_class(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _classified(spark, d).where(F.col("class") == kind).select("container", "language", "line", "n", F.round("score", 6).alias("score"))

    return query


def string_match_rank(spark: SparkSession, d: str) -> DataFrame:
    cache, classified = _materials(spark, d)
    scores = M.package_scores(classified, cache).where("unique_score > 0")
    out = M.rank(scores.select("container", "package", F.round(F.col("unique_score") + F.col("nonunique_score"), 6).alias("score")))
    return out.withColumn("share", F.round("share", 6))


def greedy_cover_rank(spark: SparkSession, d: str) -> DataFrame:
    cache, classified = _materials(spark, d)
    scores = M.package_scores(classified, cache)
    cover = M.greedy_cover(classified, cache, scores, K.average_strings(B.strings(spark, d), B.files(spark, d)))
    both = scores.join(cover, ["container", "package"], "full").fillna(0.0).where("unique_score > 0 or same_file_score > 0")
    return M.rank(both.select("container", "package", (F.col("unique_score") + F.col("nonunique_score") + F.col("same_file_score")).alias("score")))


def _numbered(spark: SparkSession, d: str, cutoff: int) -> M.Numbered:
    return M.numbered_tables(B.strings(spark, d).withColumnRenamed("row_id", "ordinal"), B.files(spark, d), B.contents(spark, d), cutoff=cutoff)


def source_order_matches(spark: SparkSession, d: str) -> DataFrame:
    return M.source_order_of(_numbered(spark, d, 0))


def source_order_direct(spark: SparkSession, d: str) -> DataFrame:
    return M.direct_matches_of(_numbered(spark, d, M.CUTOFF))


def source_order_rank(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d, M.CUTOFF)
    scores = M.source_order_scores_of(n, cut(K.average_strings(n.strings, n.files)))
    total = F.col("unique_score") + F.col("nonunique_score") + F.col("direct_score") + F.col("same_file_score")
    return M.rank(scores.select("container", "package", total.alias("score")))


def fallback_match(spark: SparkSession, d: str) -> DataFrame:
    lines = B.identifiers(spark, d).where("line is not null").select(F.concat(F.lit("<6>"), F.col("line")).alias("message")).distinct()
    known = B.strings(spark, d).where("line is not null").select(F.col("line").alias("found")).distinct()
    return M.first_variant(lines, ["message"], M.kernel_variants(F.col("message")), known, "found")


def class_fallback_match(spark: SparkSession, d: str) -> DataFrame:
    names = B.functions(spark, d).where("name is not null").select(F.concat(F.lit("org.example."), F.col("name"), F.lit("$1")).alias("class_name")).distinct()
    known = B.functions(spark, d).where("name is not null").select(F.col("name").alias("found")).distinct()
    return M.first_variant(names, ["class_name"], M.class_variants(F.col("class_name")), known, "found")


def function_matches(spark: SparkSession, d: str) -> DataFrame:
    f = B.functions(spark, d).where("name is not null and key is not null and name != 'main'").select("key", "name").distinct()
    p = B.files(spark, d).select("key", "package").dropna().distinct()
    met = f.join(p, "key").select("name", "package").distinct()
    return met.groupBy("name").agg(F.count(F.lit(1)).alias("packages"), F.min("package").alias("first_package"))


def function_semi_match(spark: SparkSession, d: str) -> DataFrame:
    """Strings that are names of functions."""
    names = B.functions(spark, d).select(F.col("name").alias("line")).where("line is not null").distinct()
    found = B.strings(spark, d).where("line is not null").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return found.join(names, "line", "left_semi")


def jar_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Unique scores of the files in each RPM, rolled up to the RPM."""
    facts = K.line_facts(_cache(spark, d)).where("n_packages = 1").select("language", "line", "package")
    child = B.strings(spark, d).dropna(subset=["key", "language", "line"]).select("key", "language", "line").distinct()
    scores = child.join(facts, ["language", "line"]).groupBy(F.col("key").alias("child"), "package").agg(F.sum(F.length("line")).cast("double").alias("score"))
    edges = B.contents(spark, d).select(F.col("container").alias("parent"), F.col("key").alias("child")).dropna()
    return M.roll_up(edges, scores).withColumn("share", F.round("share", 6))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    unique = M.classify(M.lines_of(B.identifiers(spark, d)), cut(_cache(spark, d))).where("class = 'unique'")
    return A.versions_of(unique, B.strings(spark, d), B.files(spark, d))


def version_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d)


def version_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.version_histogram(_versions(spark, d))


def version_prune(spark: SparkSession, d: str) -> DataFrame:
    return A.matched_versions(B.strings(spark, d), B.files(spark, d), B.contents(spark, d), cutoff=M.CUTOFF)


def function_version_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.row_versions(B.functions(spark, d), B.files(spark, d))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Two judges of each file row: the mark in the table, and the path."""
    f = B.files(spark, d)
    marked = f.where("thirdparty is not null").select(F.col("row_id").alias("key"), F.lit("mark").alias("scanner"), F.when(F.col("thirdparty"), "foreign").otherwise("own").alias("verdict"))
    path = F.when(F.col("pathname").rlike("/(vendor|external|node_modules|third_?party|3rdparty)/"), "copy").otherwise("plain")
    return marked.unionByName(f.where("pathname is not null").select(F.col("row_id").alias("key"), F.lit("path").alias("scanner"), path.alias("verdict")))


def license_agreement(spark: SparkSession, d: str) -> DataFrame:
    return A.agreement(_verdicts(spark, d), "mark", "path")


def license_squash(spark: SparkSession, d: str) -> DataFrame:
    out = A.squash(_verdicts(spark, d), {"foreign": "copy", "own": "plain"}, "mark", "path")
    return out.groupBy("scanner", "verdict").agg(F.count(F.lit(1)).alias("n"))


_CLASS = "SELECT container, language, line, n, {score} AS score FROM classified WHERE class = '{k}'"
_VERSIONS = """v AS (SELECT DISTINCT c.container, c.package, c.line, pf.version FROM classified c JOIN es ON es.language = c.language AND es.line = c.line
  JOIN pf ON pf.ck = es.ck AND pf.package = c.package WHERE class = 'unique' AND pf.version IS NOT NULL)"""
_VERDICTS = """vd AS (SELECT row_id AS key, 'mark' AS scanner, CASE WHEN thirdparty THEN 'foreign' ELSE 'own' END AS verdict FROM pf WHERE thirdparty IS NOT NULL
  UNION ALL SELECT row_id, 'path', CASE WHEN regexp_matches(pathname, '/(vendor|external|node_modules|third_?party|3rdparty)/') THEN 'copy' ELSE 'plain' END FROM pf WHERE pathname IS NOT NULL)"""

SQL = {
    "kb_identifier_cache": with_base("SELECT language, line, package, filename FROM cache"),
    "score_table": with_base("""SELECT language, line, n_packages AS packages, round(CASE WHEN n_packages = 1 THEN length(line)
        WHEN length(line) / pow(5.0, n_filenames - 1) < 1e-37 THEN 0 ELSE length(line) / pow(5.0, n_filenames - 1) END, 6) AS score FROM facts"""),
    "avgstrings": with_base("""SELECT language, package, round(avg(n), 6) AS avgstrings FROM (SELECT language, package, version, count(DISTINCT line) AS n FROM es JOIN pf USING (ck)
        WHERE language IS NOT NULL AND line IS NOT NULL AND package IS NOT NULL AND version IS NOT NULL GROUP BY ALL) GROUP BY ALL"""),
    "alias_rewrite": """SELECT coalesce(r.newname, p.package) AS package, count(*) AS n FROM processed p
        LEFT JOIN (SELECT originalname, arg_min_null(newname, row_id) AS newname FROM renames WHERE originalname IS NOT NULL GROUP BY 1) r ON p.package = r.originalname
        WHERE p.package IS NOT NULL GROUP BY 1""",
    "match_counters": with_base("""SELECT container, sum(n)::BIGINT AS lines, """ + ", ".join(f"(sum(CASE WHEN class = '{c}' THEN n ELSE 0 END))::BIGINT AS {c}" for c in ("ignored", "unmatched", "unique", "nonassigned", "notclone", "cloned")) + " FROM classified GROUP BY container"),
    "match_classes": with_base("SELECT container, language, line, n, class FROM classified"),
    "unmatched_strings": with_base("SELECT container, language, line, n FROM classified WHERE class = 'unmatched'"),
    "ignored_strings": with_base("SELECT container, language, line, n FROM lines WHERE length(line) < 12"),
    "unique_matches": with_base(_CLASS.format(k="unique", score="length(line)::DOUBLE")),
    "notclone_matches": with_base(_CLASS.format(k="notclone", score="round(shared, 6)")),
    "cloned_matches": with_base(_CLASS.format(k="cloned", score="round(shared, 6)")),
    "string_match_rank": with_base(""", parts AS (SELECT container, package, length(line)::DOUBLE AS u, 0::DOUBLE AS o FROM classified WHERE class = 'unique'
        UNION ALL SELECT c.container, k.package, 0::DOUBLE, c.shared FROM classified c JOIN cache k USING (language, line) WHERE class = 'notclone'),
        s AS (SELECT container, package, round(sum(u) + sum(o), 6) AS score FROM parts GROUP BY ALL HAVING sum(u) > 0)
        SELECT container, package, score, round(score / sum(score) OVER (PARTITION BY container) * 100, 6) AS share,
        row_number() OVER (PARTITION BY container ORDER BY score DESC, package) AS rank FROM s""".replace(", parts", ", parts", 1)),
    "source_order_matches": with_base(""", o AS (SELECT i.*, CASE WHEN f.n_packages = 1 THEN f.package END AS op, CASE WHEN f.n_packages = 1 THEN i.line END AS ul
        FROM ids i LEFT JOIN facts f USING (language, line) WHERE i.line IS NOT NULL AND i.language IS NOT NULL),
        w AS (SELECT *, last_value(op IGNORE NULLS) OVER b AS p, last_value(ul IGNORE NULLS) OVER b AS l FROM o
          WINDOW b AS (PARTITION BY container, language ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT DISTINCT w.container, w.language, w.ordinal, w.line, w.p AS package FROM w JOIN cache a ON a.language = w.language AND a.line = w.line AND a.package = w.p
        JOIN cache b ON b.language = w.language AND b.line = w.l AND b.filename = a.filename WHERE w.op IS NULL"""),
    "fallback_match": with_base(""", q AS (SELECT DISTINCT '<6>' || line AS message FROM ids WHERE line IS NOT NULL), k AS (SELECT DISTINCT line AS found FROM es WHERE line IS NOT NULL),
        v AS (SELECT message, 0 AS variant, message AS found FROM q UNION ALL SELECT message, 1, regexp_replace(message, '^<[0-9cd]>', '') FROM q
          UNION ALL SELECT message, 2, regexp_replace(substr(message, instr(message, ':') + 1), '^ ', '') FROM q WHERE instr(message, ':') > 0
          UNION ALL SELECT message, 3, substr(message, 2) FROM q WHERE regexp_matches(message, '^[0-9]'))
        SELECT message, variant, found FROM v JOIN k USING (found) WHERE found <> '' QUALIFY row_number() OVER (PARTITION BY message ORDER BY variant) = 1"""),
    "class_fallback_match": with_base(""", q AS (SELECT DISTINCT 'org.example.' || name || '$1' AS class_name FROM ef WHERE name IS NOT NULL), k AS (SELECT DISTINCT name AS found FROM ef WHERE name IS NOT NULL),
        v AS (SELECT class_name, 0 AS variant, split_part(class_name, '$', 1) AS found FROM q UNION ALL SELECT class_name, 1, list_last(string_split(split_part(class_name, '$', 1), '.')) FROM q)
        SELECT class_name, variant, found FROM v JOIN k USING (found) WHERE found <> '' QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY variant) = 1"""),
    "function_matches": with_base("""SELECT name, count(DISTINCT package) AS packages, min(package) AS first_package FROM ef JOIN pf USING (ck)
        WHERE name IS NOT NULL AND name <> 'main' AND package IS NOT NULL GROUP BY name"""),
    "function_semi_match": with_base("SELECT line, count(*) AS n FROM es WHERE line IN (SELECT name FROM ef WHERE name IS NOT NULL) GROUP BY line"),
    "jar_rollup": with_base(""", c AS (SELECT ck, package, sum(length(line))::DOUBLE AS score FROM (SELECT DISTINCT ck, language, line FROM es WHERE ck IS NOT NULL) JOIN facts USING (language, line)
        WHERE n_packages = 1 GROUP BY ALL), s AS (SELECT container, package, sum(score) AS score FROM (SELECT DISTINCT container, ck FROM rc WHERE container IS NOT NULL) JOIN c USING (ck) GROUP BY ALL)
        SELECT container, package, score, round(score / sum(score) OVER (PARTITION BY container) * 100, 6) AS share, row_number() OVER (PARTITION BY container ORDER BY score DESC, package) AS rank FROM s"""),
    "version_attribution": with_base(f", {_VERSIONS} SELECT * FROM v"),
    "version_histogram": with_base(f""", {_VERSIONS} SELECT *, row_number() OVER (PARTITION BY container, package ORDER BY n_lines DESC, version) AS place
        FROM (SELECT container, package, version, count(*) AS n_lines FROM v GROUP BY ALL)"""),
    "version_prune": with_base(f""", {_VERSIONS}, n AS (SELECT container, package, version, count(*) AS n FROM v GROUP BY ALL),
        sh AS (SELECT a.container, a.package, a.version AS va, b.version AS vb, count(*) AS s FROM v a JOIN v b USING (container, package, line) WHERE a.version <> b.version GROUP BY ALL)
        SELECT container, package, version FROM n WHERE NOT EXISTS (SELECT 1 FROM sh JOIN n b ON b.container = sh.container AND b.package = sh.package AND b.version = sh.vb
          WHERE sh.container = n.container AND sh.package = n.package AND sh.va = n.version AND sh.s = n.n AND n.n < b.n)"""),
    "function_version_counts": with_base("""SELECT package, version, count(*) AS n FROM (SELECT DISTINCT name, ck, linenumber FROM ef WHERE name IS NOT NULL AND ck IS NOT NULL)
        JOIN (SELECT DISTINCT ck, package, version FROM pf WHERE package IS NOT NULL AND version IS NOT NULL) USING (ck) GROUP BY ALL"""),
    "license_agreement": with_base(f""", {_VERDICTS} SELECT l.verdict AS verdict_left, r.verdict AS verdict_right, count(*) AS n FROM (SELECT DISTINCT * FROM vd WHERE scanner = 'mark') l
        FULL JOIN (SELECT DISTINCT * FROM vd WHERE scanner = 'path') r USING (key) GROUP BY ALL"""),
    "license_squash": with_base(f""", {_VERDICTS}, m AS (SELECT *, CASE WHEN scanner = 'path' THEN verdict WHEN verdict = 'foreign' THEN 'copy' ELSE 'plain' END AS meaning FROM vd),
        s AS (SELECT *, count(*) OVER (PARTITION BY key, meaning) = 2 AS both_ FROM m)
        SELECT scanner, verdict, count(*) AS n FROM (SELECT DISTINCT key, CASE WHEN both_ THEN 'squashed' ELSE scanner END AS scanner, CASE WHEN both_ THEN meaning ELSE verdict END AS verdict FROM s) GROUP BY ALL"""),
}
QUERIES = {
    f.__name__: f
    for f in (
        kb_identifier_cache, score_table, avgstrings, alias_rewrite, match_counters, match_classes, unmatched_strings, ignored_strings, string_match_rank, greedy_cover_rank, source_order_matches, source_order_direct, source_order_rank,
        fallback_match, class_fallback_match, function_matches, function_semi_match, jar_rollup, version_attribution, version_histogram, version_prune, function_version_counts, license_agreement, license_squash,
    )
} | {f"{k}_matches": _of_class(k) for k in ("unique", "notclone", "cloned")}
