"""Queries over readers, writers, text functions and the smaller operators, on inputs made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.functions import text as X
from strandline.functions.keys import checksum_text
from strandline.operators import attribute as A
from strandline.operators import audit as U
from strandline.operators import files as FL
from strandline.operators import graph as G
from strandline.operators import scans as S
from strandline.plans import base as P
from strandline.plans.base import with_base
from strandline.session import scratch
from strandline.sources import formats as R
from strandline.sources import sinks as W
from strandline.sources import table


def _lines(df: DataFrame, line) -> str:
    """The path of a text file of lines."""
    path = scratch(df.sparkSession, "lines")
    df.select(line.alias("value")).write.text(path)
    return path


def read_package_list(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "processed").select("package", "version", "filename", "origin").where("filename is not null and package is not null and package != '' and not rlike(concat_ws('', package, version, filename, origin), '[\\t\\n\\r\"\\\\\\\\]')")
    return R.package_list(spark, _lines(own, F.concat_ws("\t", *[F.coalesce(c, F.lit("-")) for c in own.columns])))


def read_download_urls(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "processed").where("downloadurl is not null and website is not null").select("downloadurl", "website")
    return R.download_urls(spark, _lines(own, F.concat_ws("\t", "downloadurl", "website")))


def read_hash_manifest(spark: SparkSession, d: str) -> DataFrame:
    """md5 and sha1 of the heads, by a manifest."""
    own = table(spark, d, "source_head").where("head is not null")
    lines = own.select(F.concat_ws(" ", checksum_text(F.col("checksum")), F.md5("head"), F.sha1(F.col("head").cast("binary"))).alias("value"))
    head = spark.createDataFrame([("filename md5 sha1",)], "value string")
    return R.hash_manifest(spark, _lines(head.unionByName(lines).coalesce(1), F.col("value")))


def read_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Versions after a rewrite list that gives every archive of an even row another name."""
    own = table(spark, d, "processed").select("row_id", "package", "version", "filename", "origin").where("package is not null and origin is not null and filename is not null and not contains(concat(package, version, filename, origin), ' ') and package != '' and version != '' and not rlike(package, '\\\\s')")
    rewrites = own.where("row_id % 2 = 0").select(F.concat_ws(" ", "package", "version", "filename", "origin", F.lit("-"), F.concat("package", F.lit("-new")), F.lit("9")).alias("v")).distinct()
    new = R.rewrite_list(spark, _lines(rewrites, F.col("v")))
    return R.rewritten(own.drop("row_id"), new).groupBy("package", "version").agg(F.count(F.lit(1)).alias("n"))


def read_distribution(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "processed_file").where("pathname is not null and package is not null and not rlike(pathname, '\\\\s')").select(F.concat_ws("    ", "pathname", F.concat(F.lit("net/"), "package")).alias("v"))
    return R.distribution_contents(spark, _lines(own, F.col("v")))


def read_file_lists(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "processed_file").where("filename is not null and package is not null")
    lists = own.groupBy("package").agg(F.array_join(F.array_sort(F.collect_set("filename")), "/").alias("filenames")).withColumn("directory", F.lit("usr/src"))
    return R.package_file_list(lists)


def read_vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerable files by a feed that names every package version of a row divisible by 3."""
    own = table(spark, d, "processed_file").where("row_id % 3 = 0 and package is not null and version is not null and pathname is not null").select("row_id", "package", "version", "pathname")
    entry = F.concat(F.lit('<entry id="CVE-'), F.col("row_id").cast("string"), F.lit('"><vuln:vulnerable-software-list><vuln:product>cpe:/a:v:'), F.col("package"), F.lit(":"), F.col("version"), F.lit("</vuln:product></vuln:vulnerable-software-list></entry>"))
    line = lambda x: spark.createDataFrame([(x,)], "value string")
    feed = line('<nvd xmlns:vuln="v">').unionByName(own.select(entry.alias("value"))).unionByName(line("</nvd>")).coalesce(1)
    cves = R.vulnerabilities(spark, _lines(feed, F.col("value"))).withColumn("path", F.lit(".h"))
    files = P.files(spark, d).select(F.hex("key").alias("key"), "package", "version", "pathname")
    return R.vulnerable_files(cves.withColumn("cve", F.substring("cve", 5, 20)), files).groupBy("cve").agg(F.count(F.lit(1)).alias("n"))


def read_binaries(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and checksums of the table files themselves, read as binaries, against the rows of one of them."""
    path = scratch(spark, "text")
    table(spark, d, "source_head").where("head is not null").select("head").coalesce(1).write.text(path, lineSep="\x00")
    found = R.binary_files(spark, path)
    return found.where("path like '%.txt'").select(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def written_reports(spark: SparkSession, d: str) -> DataFrame:
    """Counts of files by version, written as JSON and as CSV, appended, appended again, partly replaced, and read back."""
    own = table(spark, d, "processed_file").where("package is not null and version is not null").groupBy("package", "version").agg(F.count(F.lit(1)).alias("n"))
    at = scratch(spark, "reports")
    W.write_reports(own, f"{at}/json")
    W.write_csv(own, f"{at}/csv")
    for _ in range(2):
        W.append_new(own, f"{at}/new", ["package", "version"])
    W.append_facts(own, f"{at}/facts", ["package"])
    first = own.agg(F.min("package").alias("package"))
    W.replace_partitions(own.join(first, "package").select("version", (F.col("n") + 1000).alias("n"), "package"), f"{at}/facts", ["package"])
    read = {
        "json": spark.read.schema(own.schema).json(f"{at}/json"), "csv": spark.read.option("header", True).schema(own.schema).csv(f"{at}/csv"), "new": spark.read.parquet(f"{at}/new"),
        "facts": spark.read.schema("version string, n long, package string").parquet(f"{at}/facts"),
    }
    out = [df.select(F.lit(k).alias("kind"), "package", "n") for k, df in read.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3]).groupBy("kind", "package").agg(F.count(F.lit(1)).alias("versions"), F.sum("n").alias("n"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Pieces between control characters, literals, places in lines and normal paths, for all documents and paths."""
    docs = table(spark, d, "documents").where("text is not null")
    probe = F.concat(F.substring("text", F.lit(1), F.length("text")), F.lit("\n@end"))
    return docs.select(
        "doc_id", F.size(X.pieces(F.concat(F.lit("a\x01\x02b\x7f"), F.regexp_replace("text", r"[\x00-\x08\x0e-\x1f\x7f]", " "), F.lit("\x03")))).alias("pieces"), X.line_at(probe, F.instr(probe, "\n@end") + 1).alias("last_line"),
        F.md5(X.unescaped(F.concat(F.lit('say \\"'), F.regexp_replace("text", r"\\", "/"), F.lit("\\t\\\\")))).alias("literal"),
    )


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "processed_file").where("pathname is not null and package is not null and version is not null")
    cpe = X.cpe_parts(F.concat_ws(":", F.lit("cpe:/a:maker"), "package", "version"))
    return own.select("row_id", X.normal_path(F.concat(F.lit("/x/..//./"), "pathname", F.lit("/y/.."))).alias("path"), cpe["product"].alias("product"), cpe["version"].alias("version"), X.bare_function(F.concat(F.lit("ns::"), "package", F.lit("(int, char)"))).alias("name"))


def source_functions(spark: SparkSession, d: str) -> DataFrame:
    """Exported symbols and parameters in kernel source, sources in specifications, versions in banners, keys and certificates."""
    own = table(spark, d, "processed").where("filename is not null and version is not null").select("row_id", "filename", "version", F.regexp_replace("version", "[^0-9.]", "").alias("v"), F.concat(F.lit("s"), F.col("row_id").cast("string")).alias("s"))
    source = F.concat(F.lit("int x;\nEXPORT_SYMBOL("), "s", F.lit(");\nEXPORT_SYMBOL_GPL( "), "s", F.lit("_gpl );\nmodule_param("), "s", F.lit(", int, 0);\nmodule_param_named(named, "), "s", F.lit(", bool, 0);"))
    parameters = S.module_parameters(source)
    return own.select(
        "row_id", F.concat_ws(",", X.macro_arguments(source, ["EXPORT_SYMBOL", "EXPORT_SYMBOL_GPL"])).alias("symbols"), F.concat_ws(",", F.transform(parameters, lambda p: F.concat(p["name"], F.lit(":"), p["type"]))).alias("parameters"),
        F.concat_ws(",", X.spec_sources(F.concat(F.lit("Name: x\nSource0: "), F.regexp_replace("filename", r"\s", "_"), F.lit("\nPatch1: p.patch\n")))).alias("sources"), S.kernel_version(F.concat(F.lit("Linux version 2."), "v", F.lit(" (me@host)"))).alias("kernel"),
        S.busybox_version(F.concat(F.lit("BusyBox v1."), "v", F.lit("0 (2012)"))).alias("busybox"), S.is_private_key(F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), "s")).alias("private"), S.is_certificate(F.concat(F.lit(" -----BEGIN CERTIFICATE-----\n"), "s")).alias("certificate"),
    )


def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that patches add: one per head, in which every line is added to one file."""
    own = table(spark, d, "source_head").where("head is not null").select(F.col("checksum").alias("key"), F.concat(F.lit("--- a/x\n+++ b/x.c\t2012\n@@\n-gone\n+"), F.regexp_replace("head", "\n", "\n+")).alias("text"))
    return S.added_lines(own).groupBy("key", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def file_gates(spark: SparkSession, d: str) -> DataFrame:
    """Files that are scanned: not empty, none of the ignored endings."""
    own = table(spark, d, "processed_file").select("row_id", F.col("pathname").alias("path"), F.length("pathname").alias("size")).where("path is not null")
    return S.scannable(own, least=12, ignored=(".h", ".py")).select("row_id")


REGISTRY = """
[sizes]
type = leaf
method = size
priority = 5
noscan = test

[notices]
type = leaf
method = words
scanonly = header
envvars = WORD=static

[nothing]
type = leaf
method = size
enabled = no
"""


def dispatched_scans(spark: SparkSession, d: str) -> DataFrame:
    """The leaf scans of a registry, run on the heads by the tags of their files."""
    f = table(spark, d, "processed_file").where("checksum is not null and pathname is not null").groupBy(checksum_text(F.col("checksum")).alias("key")).agg(F.min("pathname").alias("path"))
    h = table(spark, d, "source_head").where("head is not null").select(checksum_text(F.col("checksum")).alias("key"), "head")
    tags = F.array_compact(F.array(F.when(F.contains("path", F.lit("/tests/")), F.lit("test")), F.when(F.endswith("path", F.lit(".h")), F.lit("header"))))
    methods = {
        "size": lambda df, settings: df.select("key", F.lit("length").alias("name"), F.length("head").alias("value")),
        "words": lambda df, settings: df.where(F.contains("head", F.lit(settings["WORD"]))).select("key", F.lit("word").alias("name"), F.lit(settings["WORD"]).alias("value")),
    }
    return S.dispatch(f.join(h, "key").withColumn("tags", tags), S.read_registry(REGISTRY), methods, "leaf")


def read_scan_results(spark: SparkSession, d: str) -> DataFrame:
    """Records of files as an earlier run wrote them, read again."""
    own = table(spark, d, "processed_file").where("pathname is not null and checksum is not null")
    record = (F.struct(F.col("filename").alias("name"), F.col("pathname").alias("path"), F.array(F.lit("text")).alias("tags"), F.col("row_id").alias("size"), F.col("checksum")))
    path = scratch(spark, "results")
    listed = own.select(record.alias("record"), (F.col("row_id") % 8).alias("k")).groupBy("k").agg(F.to_json(F.collect_list("record")).alias("value"))
    listed.write.partitionBy("k").text(path)
    return R.scan_results(spark, path).select("name", "path", "size", F.element_at("tags", 1).alias("tag"))


def undeclared_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Packages that alone define what the files of an RPM use, beside those of its own files."""
    f = P.files(spark, d).select("key", "package").dropna().distinct()
    s = P.functions(spark, d).where("name is not null and key is not null").select("key", F.col("name").alias("symbol"), F.coalesce("language", F.lit("-")).alias("kind"))
    defined = s.join(f, "key").select(F.col("package").alias("library"), "symbol", "kind").distinct()
    inside = P.contents(spark, d).select("container", "key").dropna().distinct()
    undefined = s.join(inside, "key").select(F.col("container").alias("file"), "symbol", "kind").distinct()
    held = undefined.where("length(symbol) % 2 = 0")
    return G.undeclared_edges(undefined, held, defined)


def trailers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("offset"))
    return FL.next_trailer(e.where("offset % 2 = 0"), e.where("offset % 5 = 0"))


def chunked_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents in overlapping pieces; a mark that lies anywhere is whole in at least one."""
    own = table(spark, d, "documents").where("text is not null and text != ''").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("content"))
    return S.chunks(own, 512, 16).groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).cast("long").alias("bytes"))


def tag_statistics(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "extracted_function").where("language is not null").select(F.array("language", F.lit("all")).alias("tags"), F.col("linenumber").cast("long").alias("size"))
    return FL.tag_statistics(own)


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Ends of links: each row of processed links to the row before it in its hundred."""
    own = table(spark, d, "processed").select(F.col("row_id").alias("path"), F.when(F.col("row_id") % 100 != 0, F.col("row_id") - 1).alias("target"))
    return G.resolved_links(own)


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Packages of the names of functions, with the kind of name by the language."""
    kind = F.when(F.col("language") == "Java", "method").when(F.col("language").isin("JavaScript", "ActionScript"), "field").when(F.startswith("name", F.lit("__")), "kernelsymbol").otherwise("variable")
    s = P.functions(spark, d).where("name is not null and key is not null").select("key", "name", kind.alias("kind"))
    return s.join(P.files(spark, d).select("key", "package").dropna().distinct(), "key").select("kind", "name", "package").distinct()


def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """(kind, name, packages): packages of each name by its kind, without the names of the stop list of that kind."""
    stops = {"field": fixed.COMMON_FIELDS, "variable": fixed.COMMON_VARIABLES, "method": fixed.COMMON_METHODS}
    common = F.lit(False)
    for kind, names in stops.items():
        common = common | ((F.col("kind") == kind) & F.col("name").isin(list(names)))
    return _named(spark, d).where(~common).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("packages"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """(key, licence, scanner): verdicts of two scanners by the rows' numbers, in the words of each."""
    pairs = sorted(fixed.VERDICTS.items())
    left, right = (F.array(*[F.lit(p[i]) for p in pairs]) for i in (0, 1))
    f = P.files(spark, d).where("key is not null").groupBy("key").agg(F.min("row_id").alias("r"))
    at = lambda words, n: F.element_at(words, (F.pmod(n, F.lit(len(pairs))) + 1).cast("int"))
    both = f.select("key", at(left, F.col("r")).alias("licence"), F.lit("one").alias("scanner")).unionByName(f.select("key", at(right, F.col("r") + F.pmod("r", F.lit(3))).alias("licence"), F.lit("other").alias("scanner")))
    return both


def license_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Licences of the files of each package, after verdicts of the same meaning are squashed."""
    judged = A.squash(_judged(spark, d).select("key", "scanner", F.col("licence").alias("verdict")), fixed.VERDICTS, "one", "other")
    own = P.files(spark, d).select("key", "package").dropna().distinct()
    found = A.licences_of(own, judged.select("key", F.col("verdict").alias("licence"), "scanner"))
    return own.join(found, "key").groupBy("package", "licence", "scanner").agg(F.count(F.lit(1)).alias("files"))


def copyright_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Copyright lines of the files of each package: those with a sign are notices, those without are statements."""
    lines = P.strings(spark, d).where(U.copyright_line(F.col("line")))
    kind = F.when(F.contains("line", F.lit("©")), "notice").otherwise("statement")
    own = P.files(spark, d).select("key", "package").dropna().distinct()
    found = A.copyrights_of(own, lines.select("key", F.col("line").alias("copyright"), kind.alias("type")))
    return own.join(found, "key").select("package", "copyright").distinct().groupBy("package").agg(F.count(F.lit(1)).alias("copyrights"))


def option_differences(spark: SparkSession, d: str) -> DataFrame:
    """Names of functions, as options, that only one of two languages has."""
    own = lambda x: P.functions(spark, d).where((F.col("language") == x) & F.col("name").isNotNull()).select(F.upper("name").alias("option"))
    return S.option_differences(own("C"), own("Python"))


def plugin_hosts(spark: SparkSession, d: str) -> DataFrame:
    """How many names that a package of a number ending in 7 leaves open each other package defines."""
    own = _named(spark, d).select(F.col("package").alias("file"), F.col("name").alias("symbol")).distinct()
    plugins = table(spark, d, "canonical_package").where("package_id % 10 = 7").select(F.col("package").alias("file"))
    return G.plugin_uses(plugins, own, own)


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    r = P.functions(spark, d).where("name is not null and language is not null and key is not null")
    return G.edge_counts(r.select(F.hex("key").alias("src"), F.substring("name", 1, 3).alias("dst"), F.col("language").alias("type")))


def password_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of passwords that are known."""
    shadow = table(spark, d, "processed").select(F.col("package").alias("login"), F.md5("version").alias("hash"))
    known = table(spark, d, "processed_file").select(F.md5("version").alias("hash"), F.col("version").alias("password"))
    return U.log_in_hits(shadow, known).select(F.col("login").alias("entry"), F.col("password").alias("key"))


def crc_hits(spark: SparkSession, d: str) -> DataFrame:
    """Entries of archives whose plain content is known by its sum: every head is an entry, those of even rows are known."""
    h = table(spark, d, "extracted_string").where("stringidentifier is not null").select("row_id", F.crc32(F.col("stringidentifier").cast("binary")).alias("crc"))
    known = h.where("row_id % 2 = 0").select("crc", F.lit("known").alias("key"))
    return U.crc_matches(h.select(F.col("row_id").alias("entry"), "crc"), known).select("entry", "key")


_OWN = (
    read_package_list, read_download_urls, read_hash_manifest, read_rewrites, read_distribution, read_file_lists, read_vulnerabilities, read_binaries, written_reports, text_functions, path_functions, source_functions, diff_lines, file_gates, trailers, chunked_contents,
    dispatched_scans, read_scan_results, undeclared_libraries, tag_statistics, link_targets, name_matches, license_attribution, copyright_attribution, option_differences, plugin_hosts, edge_counts, password_hits, crc_hits,
)
QUERIES = {f.__name__: f for f in _OWN}

_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_KINDS = """n AS (SELECT DISTINCT CASE WHEN language = 'Java' THEN 'method' WHEN language IN ('JavaScript', 'ActionScript') THEN 'field' WHEN starts_with(name, '__') THEN 'kernelsymbol' ELSE 'variable' END AS kind, name, package
  FROM ef JOIN pf USING (ck) WHERE name IS NOT NULL AND package IS NOT NULL)"""
_PAIRS = sorted(fixed.VERDICTS.items())
_REPORTS = "c AS (SELECT package, version, count(*) AS n FROM processed_file WHERE package IS NOT NULL AND version IS NOT NULL GROUP BY ALL)"
SQL = {
    "read_package_list": """SELECT package, coalesce(version, '-') AS version, filename, coalesce(origin, '-') AS origin FROM processed WHERE filename IS NOT NULL AND package IS NOT NULL AND package <> ''
        AND NOT regexp_matches(concat(package, version, filename, origin), '[\\t\\n\\r"\\\\]')""",
    "read_download_urls": "SELECT downloadurl, website FROM processed WHERE downloadurl IS NOT NULL AND website IS NOT NULL",
    "read_hash_manifest": """SELECT lower(trim(checksum, ' ')) AS filename, hash, CASE hash WHEN 'md5' THEN md5(head) ELSE sha1(head) END AS value FROM source_head, (SELECT unnest(['md5', 'sha1']) AS hash) WHERE head IS NOT NULL""",
    "read_rewrites": """WITH o AS (SELECT * FROM processed WHERE package IS NOT NULL AND origin IS NOT NULL AND filename IS NOT NULL AND NOT contains(package || version || filename || origin, ' ') AND package <> '' AND version <> '' AND NOT regexp_matches(package, '\\s')),
        e AS (SELECT DISTINCT package, version, filename, origin, 1 AS k FROM o WHERE row_id % 2 = 0)
        SELECT CASE WHEN k = 1 THEN o.package || '-new' ELSE o.package END AS package, CASE WHEN k = 1 THEN '9' ELSE o.version END AS version, count(*) AS n
        FROM o LEFT JOIN e ON e.package = o.package AND e.version = o.version AND e.filename = o.filename AND e.origin = o.origin GROUP BY ALL""",
    "read_distribution": """SELECT list_last(string_split(pathname, '/')) AS filename, regexp_replace(pathname, '/?[^/]*$', '') AS directory, package FROM processed_file WHERE pathname IS NOT NULL AND package IS NOT NULL AND NOT regexp_matches(pathname, '\\s')""",
    "read_file_lists": "SELECT DISTINCT filename, 'usr/src' AS directory, package FROM processed_file WHERE filename IS NOT NULL AND package IS NOT NULL",
    "read_vulnerabilities": with_base("""SELECT a.row_id::VARCHAR AS cve, count(DISTINCT (b.ck, b.pathname)) AS n FROM pf a JOIN pf b ON a.package = b.package AND a.version = b.version
        WHERE a.row_id % 3 = 0 AND a.pathname IS NOT NULL AND b.pathname LIKE '%.h' GROUP BY 1"""),
    "read_binaries": "SELECT sum(octet_length(encode(head)) + 1)::BIGINT AS bytes, 1 AS files FROM source_head WHERE head IS NOT NULL",
    "written_reports": f"""WITH {_REPORTS} SELECT kind, package, count(*) AS versions, sum(n + CASE WHEN kind = 'facts' AND package = (SELECT min(package) FROM c) THEN 1000 ELSE 0 END)::BIGINT AS n
        FROM c, (SELECT unnest(['json', 'csv', 'new', 'facts']) AS kind) GROUP BY ALL""",
    "text_functions": """SELECT doc_id, CASE WHEN text = '' THEN 2 ELSE 3 END AS pieces, length(text) - length(replace(text, chr(10), '')) + 2 AS last_line, md5('say "' || replace(replace(replace(text, '\\', '/'), '\\"', '"'), '\\t', chr(9)) || chr(9) || '\\') AS literal
        FROM documents WHERE text IS NOT NULL""",
    "path_functions": """SELECT row_id, '/' || regexp_replace(regexp_replace(pathname, '^(\\./)+', ''), '/(\\./)+', '/', 'g') AS path, package AS product, version, package AS name FROM processed_file WHERE pathname IS NOT NULL AND package IS NOT NULL AND version IS NOT NULL""",
    "source_functions": """WITH o AS (SELECT row_id, filename, regexp_replace(version, '[^0-9.]', '', 'g') AS v, 's' || row_id AS s FROM processed WHERE filename IS NOT NULL AND version IS NOT NULL)
        SELECT row_id, s || ',' || s || '_gpl' AS symbols, s || ':int,named:bool' AS parameters, regexp_replace(filename, '\\s', '_', 'g') || ',p.patch' AS sources, '2.' || v AS kernel, '1.' || v || '0' AS busybox, true AS private, true AS certificate FROM o""",
    "diff_lines": "SELECT checksum AS key, 'x.c' AS path, length(head) - length(replace(head, chr(10), '')) + 1 AS n, length(replace(head, chr(10), '')) AS chars FROM source_head WHERE head IS NOT NULL",
    "file_gates": "SELECT row_id FROM processed_file WHERE length(pathname) >= 12 AND NOT (ends_with(pathname, '.h') OR ends_with(pathname, '.py'))",
    "dispatched_scans": """WITH f AS (SELECT lower(trim(checksum, ' ')) AS key, min(pathname) AS path FROM processed_file WHERE checksum IS NOT NULL AND pathname IS NOT NULL GROUP BY 1),
        x AS (SELECT key, path, head FROM f JOIN source_head ON lower(trim(checksum, ' ')) = key WHERE head IS NOT NULL)
        SELECT 'sizes' AS scan, 5 AS priority, key, 'length' AS name, length(head)::VARCHAR AS value FROM x WHERE NOT contains(path, '/tests/')
        UNION ALL SELECT 'notices', 0, key, 'word', 'static' FROM x WHERE ends_with(path, '.h') AND contains(head, 'static')""",
    "read_scan_results": "SELECT filename AS name, pathname AS path, row_id AS size, 'text' AS tag FROM processed_file WHERE pathname IS NOT NULL AND checksum IS NOT NULL",
    "undeclared_libraries": with_base(""", s AS (SELECT ck, name AS symbol, coalesce(language, '-') AS kind FROM ef WHERE name IS NOT NULL AND ck IS NOT NULL),
        o AS (SELECT symbol, kind, min(package) AS library FROM s JOIN pf USING (ck) WHERE package IS NOT NULL GROUP BY ALL HAVING count(DISTINCT package) = 1),
        u AS (SELECT DISTINCT container AS file, symbol, kind FROM s JOIN rc USING (ck) WHERE container IS NOT NULL AND length(symbol) % 2 = 1)
        SELECT file, library, count(*) AS symbols FROM u JOIN o USING (symbol, kind) WHERE file <> library GROUP BY ALL"""),
    "trailers": """WITH t AS (SELECT user_id AS key, event_id AS o FROM events WHERE event_id % 5 = 0)
        SELECT user_id AS key, event_id AS header, min(o) AS trailer FROM events JOIN t ON t.key = user_id AND o >= event_id WHERE event_id % 2 = 0 GROUP BY user_id, event_id""",
    "chunked_contents": """WITH o AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL AND text <> ''), s AS (SELECT doc_id, n, unnest(range(0, n, 512)) AS i FROM o)
        SELECT doc_id AS key, count(*) AS chunks, sum(least(528, n - i))::BIGINT AS bytes FROM s GROUP BY doc_id""",
    "tag_statistics": "SELECT tag, count(*) AS n, sum(linenumber)::BIGINT AS bytes FROM (SELECT linenumber, unnest([language, 'all']) AS tag FROM extracted_function WHERE language IS NOT NULL) GROUP BY tag",
    "link_targets": """WITH RECURSIVE o AS (SELECT DISTINCT row_id AS p, row_id - 1 AS t FROM processed WHERE row_id % 100 <> 0), c AS (SELECT p, t FROM o UNION ALL SELECT c.p, o.t FROM c JOIN o ON o.p = c.t)
        SELECT p AS path, min(t) AS target FROM c GROUP BY p""",
    "name_matches": with_base(f""", {_KINDS} SELECT kind, name, count(*) AS packages FROM n WHERE NOT (kind = 'field' AND name IN ({_IN(fixed.COMMON_FIELDS)})) AND NOT (kind = 'variable' AND name IN ({_IN(fixed.COMMON_VARIABLES)}))
        AND NOT (kind = 'method' AND name IN ({_IN(fixed.COMMON_METHODS)})) GROUP BY ALL"""),
    "license_attribution": with_base(f""", w AS (SELECT [{_IN(p[0] for p in _PAIRS)}] AS a, [{_IN(p[1] for p in _PAIRS)}] AS b), f AS (SELECT ck, min(row_id) AS r FROM pf WHERE ck IS NOT NULL GROUP BY ck),
        v AS (SELECT ck, a[r % len(a) + 1] AS x, b[r % len(b) + 1] AS m, b[(r + r % 3) % len(b) + 1] AS y FROM f, w),
        l AS (SELECT ck, 'squashed' AS scanner, y AS licence FROM v WHERE m = y UNION ALL SELECT ck, 'one', x FROM v WHERE m <> y UNION ALL SELECT ck, 'other', y FROM v WHERE m <> y)
        SELECT package, licence, scanner, count(*) AS files FROM (SELECT DISTINCT ck, package FROM pf WHERE package IS NOT NULL) JOIN l USING (ck) GROUP BY ALL"""),
    "copyright_attribution": with_base("""SELECT package, count(DISTINCT line) AS copyrights FROM es JOIN pf USING (ck) WHERE package IS NOT NULL AND contains(line, '©') GROUP BY package"""),
    "option_differences": with_base(""", o AS (SELECT DISTINCT language, upper(name) AS option FROM ef WHERE name IS NOT NULL AND language IN ('C', 'Python') AND NOT regexp_matches(upper(name), 'FEATURE|ASH'))
        SELECT option, CASE WHEN min(language) = 'C' THEN 'left' ELSE 'right' END AS side FROM o GROUP BY option HAVING count(*) = 1"""),
    "plugin_hosts": with_base(f""", {_KINDS}, o AS (SELECT DISTINCT package, name FROM n), p AS (SELECT package FROM canonical_package WHERE package_id % 10 = 7)
        SELECT a.package AS plugin, b.package AS host, count(*) AS symbols FROM o a JOIN o b USING (name) WHERE a.package IN (SELECT package FROM p) AND b.package NOT IN (SELECT package FROM p) GROUP BY ALL"""),
    "password_hits": """WITH h AS (SELECT DISTINCT version AS password, md5(version) AS hash FROM processed_file WHERE version IS NOT NULL)
        SELECT package AS entry, password AS key FROM processed JOIN h ON h.hash = md5(version) WHERE package IS NOT NULL AND version IS NOT NULL""",
    "crc_hits": """SELECT row_id AS entry, 'known' AS key FROM extracted_string WHERE stringidentifier IN (SELECT stringidentifier FROM extracted_string WHERE row_id % 2 = 0 AND stringidentifier IS NOT NULL)
        AND stringidentifier <> ''""",
    "edge_counts": with_base("""SELECT CASE WHEN regexp_full_match(ck, '([0-9a-f]{2})*') THEN '00' || upper(ck) ELSE '01' || hex(encode(ck)) END AS src, substr(name, 1, 3) AS dst, language AS type, count(*) AS n
        FROM ef WHERE name IS NOT NULL AND language IS NOT NULL AND ck IS NOT NULL GROUP BY ALL"""),
}
