"""Queries over files, clones, audits, graphs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.functions import text as X
from strandline.functions.formats import SIGNATURES
from strandline.functions.keys import checksum_text
from strandline.operators import attribute as A
from strandline.operators import audit as U
from strandline.operators import carve as V
from strandline.operators import clones as C
from strandline.operators import files as FL
from strandline.operators import graph as G
from strandline.operators import match as M
from strandline.operators import report as R
from strandline.plans import base as B
from strandline.plans import matching
from strandline.plans.base import with_base
from strandline.sources import table

_ROOT = r"^\./"
THIRD_PARTY = "third_?party|3rdpart|external"
FORGES = {"harbor": ("codeharbor",), "mirror": ("mirrorbay",), "tools": ("toolstead",), "vendor": ("vendor-drop", "vendor drop")}
SMELLS = ("open_table", "read_buffer", "copy_entry", "write_socket")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed_file").withColumn("ck", checksum_text(F.col("checksum")))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return FL.duplicate_groups(_files(spark, d), "ck", "pathname")


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    out = FL.first_of_each(_files(spark, d).select("row_id", "ck", F.coalesce("pathname", F.lit("")).alias("p")), "ck", [F.col("p"), F.col("row_id")])
    return out.select("row_id", "duplicate")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    tag = lambda cond, name: F.when(cond, F.lit(name))
    tags = F.array_compact(F.array(tag(F.col("pathname").rlike("/tests/"), "test"), tag(F.col("pathname").rlike(r"\.h$"), "header"), tag(F.col("thirdparty"), "foreign")))
    return f.select("row_id", tags.alias("tags"))


def tag_gate(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).where(FL.gate(F.col("tags"), ("test", "header"), ("foreign",))).select("row_id")


def prune_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).where(FL.gate(F.col("tags"), (), ("test", "foreign"))).select("row_id")


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    md5, sha1, sha256, crc = FL.hashes(F.col("head").cast("binary"))
    return table(spark, d, "source_head").where("head is not null").select("checksum", md5, sha1, sha256)


def file_crc32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_head").where("head is not null").select("checksum", FL.hashes(F.col("head").cast("binary"))[3])


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pathname")
    return _files(spark, d).where("pathname is not null").select("row_id", FL.basename(p).alias("name"), FL.dirname(p).alias("dir"), F.coalesce(X.language_of(p), F.lit("-")).alias("language"))


def path_without_root(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).where("pathname is not null and package is not null and version is not null")
    return f.select("row_id", FL.without_root(F.col("pathname"), F.col("package"), F.col("version")).alias("path"))


def path_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """How many rows lie below each directory."""
    up = _files(spark, d).where("pathname is not null").select(F.explode(FL.ancestors(F.col("pathname"))).alias("directory"))
    return up.groupBy("directory").agg(F.count(F.lit(1)).alias("n"))


def _event_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("lo"), (F.col("event_id") + F.floor("value").cast("long")).alias("hi"))


def range_exclusion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") + 3).alias("x"))
    return FL.inside_ranges(e, _event_ranges(spark, d), width=64)


def range_next(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("x"))
    return FL.next_range(e, _event_ranges(spark, d))


def carve_gaps(spark: SparkSession, d: str) -> DataFrame:
    return FL.gaps(_event_ranges(spark, d))


def clone_containment(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).where("version is not null")
    return C.contained(f.select(F.concat_ws(" ", "package", "version").alias("package"), F.col("ck").alias("key")).where("package is not null"))


def package_hash_counts(spark: SparkSession, d: str) -> DataFrame:
    own = _files(spark, d).select("package", "version", "ck").dropna().distinct()
    return own.groupBy("package", "version").agg(F.count(F.lit(1)).alias("n"))


def third_party(spark: SparkSession, d: str) -> DataFrame:
    return C.third_party(B.files(spark, d), THIRD_PARTY, besides=("linux", "busybox"))


def known_files(spark: SparkSession, d: str) -> DataFrame:
    return B.contents(spark, d).join(B.files(spark, d).select("key").distinct(), "key", "left_semi").select("row_id")


def not_in_kb(spark: SparkSession, d: str) -> DataFrame:
    rest = B.contents(spark, d).where("key is not null").join(B.files(spark, d).select("key").distinct(), "key", "left_anti")
    return rest.groupBy("container").agg(F.count(F.lit(1)).alias("n"))


def hash_xref(spark: SparkSession, d: str) -> DataFrame:
    """File names in RPMs, converted to those of the knowledge base where it has the content."""
    names = B.files(spark, d).where("key is not null and filename is not null").groupBy("key").agg(F.min("filename").alias("known"))
    return B.contents(spark, d).join(names, "key", "left").select("row_id", F.coalesce("known", "filename").alias("name"))


def tree_comparison(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).select(F.col("filename").alias("name"), checksum_text(F.col("checksum")).alias("key"))
    return C.compare_trees(one("rpm_contents"), one("processed_file"))


def file2package(spark: SparkSession, d: str) -> DataFrame:
    # The archives' file names carry a number that the sources do not have.
    names = B.contents(spark, d).select("container", F.regexp_replace("filename", r"-\d+(\.[^.]*)$", "$1").alias("filename")).dropna().distinct()
    return names.join(B.files(spark, d).select("filename", "package").dropna().distinct(), "filename").groupBy("container", "package").agg(F.count(F.lit(1)).alias("names"))


def rename_merge(spark: SparkSession, d: str) -> DataFrame:
    from strandline.operators.knowledge import aliased

    rows = aliased(table(spark, d, "processed").select("row_id", "package", "version", "checksum"), table(spark, d, "renames"))
    return C.merge_renamed(rows, ["package", "version", "checksum"], "row_id").select("row_id", "package", "version")


def duplicate_archives(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").where("checksum is not null").groupBy(checksum_text(F.col("checksum")).alias("ck")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def new_contents(spark: SparkSession, d: str) -> DataFrame:
    """What an append of the RPMs' contents would add: one row per new checksum."""
    one = lambda t: table(spark, d, t).select(checksum_text(F.col("checksum")).alias("ck")).where("ck is not null")
    return C.new_rows(one("rpm_contents"), one("processed_file"), ["ck"])


def version_order(spark: SparkSession, d: str) -> DataFrame:
    v = _files(spark, d).select("package", "version").dropna().distinct()
    return v.select("package", "version", F.rank().over(Window.partitionBy("package").orderBy(X.version_key(F.col("version")))).cast("long").alias("place"))


def first_version(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).where("package is not null and version is not null and ck is not null")
    return f.groupBy("package", "ck").agg(F.min(F.struct(X.version_key(F.col("version")).alias("k"), "version")).alias("b")).select("package", "ck", F.col("b.version").alias("version"))


def archive_names(spark: SparkSession, d: str) -> DataFrame:
    parts = X.archive_parts(F.col("filename"))
    return table(spark, d, "processed").where("filename is not null").select("row_id", parts["package"].alias("package"), parts["version"].alias("version"))


def copyright_lines(spark: SparkSession, d: str) -> DataFrame:
    return B.strings(spark, d).where(U.copyright_line(F.col("line"))).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def shell_invocations(spark: SparkSession, d: str) -> DataFrame:
    lines = B.strings(spark, d).where("line is not null").select(F.concat(F.lit("/sbin/"), F.col("line")).alias("line"))
    return lines.where(U.shell_invocation(F.col("line"))).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def urls(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "processed").select("row_id", F.concat_ws(" see ", "downloadurl", "website", F.lit("http://localhost/x")).alias("t"))
    return own.select("row_id", F.explode(U.urls(F.col("t"))).alias("url"))


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "processed").where("downloadurl is not null")
    return own.groupBy(F.expr("try_parse_url(downloadurl, 'HOST')").alias("host")).agg(F.count(F.lit(1)).alias("n"))


def emails(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "processed").where("website is not null")
    text = F.concat(F.lit("mail admin@"), F.regexp_replace(F.regexp_replace("website", "^https://", ""), "/$", ""), F.lit(" or x@example.org, thanks"))
    return own.select("row_id", F.explode(U.emails(text)).alias("email"))


def forge_markers(spark: SparkSession, d: str) -> DataFrame:
    return U.marked(table(spark, d, "processed"), ["row_id"], "downloadurl", FORGES)


def license_markers(spark: SparkSession, d: str) -> DataFrame:
    return U.marked(B.strings(spark, d).select("line").distinct(), ["line"], "line", {"contributors": ("contributors", "©"), "usage": ("usage:",), "assertion": ("assertion",)})


def _with_marker(spark: SparkSession, d: str, markers: dict[str, tuple[str, ...]]) -> DataFrame:
    """Texts in which, by the document's number, one of the fixed markers was put between its halves."""
    words = F.array(*[F.lit(w) for ws in markers.values() for w in ws])
    docs = table(spark, d, "documents").where("text is not null")
    half = F.floor(F.length("text") / 2).cast("int")
    word = F.element_at(words, (F.pmod("doc_id", F.size(words)) + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.substring("text", F.lit(1), half), F.lit(" "), word, F.lit(" "), F.substring("text", half + 1, F.length("text"))).alias("t"))


def _finds(markers: dict[str, tuple[str, ...]]):
    return lambda spark, d: U.marked(_with_marker(spark, d, markers), ["doc_id"], "t", markers)


def cert_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls that the CERT rules advise against, in the heads with such a call added at the end."""
    names = (*fixed.ENV33_C, *fixed.MSC24_C)
    added = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.length("head"), F.lit(len(names))) + 1).cast("int"))
    heads = table(spark, d, "source_head").where("head is not null").select("checksum", F.concat("head", F.lit("\n"), added, F.lit(" (x);")).alias("t"))
    return U.calls(heads, ["checksum"], "t", names)


def code_smells(spark: SparkSession, d: str) -> DataFrame:
    return U.calls(table(spark, d, "source_head"), ["checksum"], "head", SMELLS)


def login_search(spark: SparkSession, d: str) -> DataFrame:
    found = U.containing(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "canonical_package").select(F.col("package").alias("word")))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("documents"))


def lcp_provider(spark: SparkSession, d: str) -> DataFrame:
    """For each function of a file: the nearest other file of the same package version that defines it too."""
    f = B.files(spark, d).select("key", "package", "version", F.col("pathname").alias("path")).dropna().distinct()
    own = B.functions(spark, d).select("key", F.col("name").alias("symbol")).dropna().distinct().join(f, "key").select("package", "version", "symbol", "path")
    return G.nearest_provider(own, own, ["package", "version"])


def equivalent_modules(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "extracted_function").select(checksum_text(F.col("checksum")).alias("key"), F.col("functionname").alias("member"))
    return G.equivalent(own).withColumnsRenamed({"key": "ck", "group": "group_ck"})


def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(table(spark, d, "renames").select(F.col("originalname").alias("src"), F.col("newname").alias("dst")))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "source_head").where("head is not null")
    return h.select(F.col("checksum").alias("key"), F.concat("checksum", F.lit(".txt")).alias("path"), F.col("head").cast("binary").alias("content"))


def file_tags(spark: SparkSession, d: str) -> DataFrame:
    return V.tagged(_contents(spark, d)).select("key", F.array_contains("tags", "text").alias("is_text"))


def file_strings(spark: SparkSession, d: str) -> DataFrame:
    """Printable runs in the heads, as a strings tool would find them."""
    return V.strings_of(_contents(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def marker_offsets(spark: SparkSession, d: str) -> DataFrame:
    return V.marker_offsets(_contents(spark, d)).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


def fuzzy_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For each file the nearest other one of the same name, by the lines of the heads."""
    h = table(spark, d, "source_head").where("head is not null").select(checksum_text(F.col("checksum")).alias("key"), F.split("head", "\n").alias("lines"))
    own = _files(spark, d).select(F.col("ck").alias("key"), F.col("filename").alias("name")).where("filename is not null and ck is not null").distinct().join(h, "key")
    return V.nearest_by_name(own, own)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "renames").select(F.col("originalname").alias("src"), F.col("newname").alias("dst")).dropna()
    return r.withColumn("kind", F.when(F.lower("src") == F.lower("dst"), "spelling").otherwise("rename")).distinct()


def edge_types(spark: SparkSession, d: str) -> DataFrame:
    return G.typed_closure(_edges(spark, d))


def library_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names of packages as needed libraries: found as a package, by a rename, or by the only archive of the name."""
    needed = table(spark, d, "processed").select(F.col("package").alias("library"))
    known = table(spark, d, "canonical_package").select(F.col("package").alias("path"), F.col("package").alias("name"))
    links = table(spark, d, "renames").where("newname is not null").select(F.col("originalname").alias("name"), F.col("newname").alias("path"))
    parts = X.archive_parts(F.col("filename"))
    sonames = table(spark, d, "processed").where("filename is not null").select(F.col("package").alias("soname"), parts["package"].alias("path")).dropna()
    return G.library_files(needed, known, links, sonames)


def _symbols(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = B.files(spark, d).select("key", "package").dropna().distinct()
    s = B.functions(spark, d).where("name is not null and key is not null").select("key", F.col("name").alias("symbol"), "language", F.startswith("name", F.lit("__")).alias("weak"))
    own = s.join(f, "key").select(F.col("package").alias("library"), "symbol", F.coalesce("language", F.lit("-")).alias("kind"), "weak").distinct()
    inside = B.contents(spark, d).select("container", "key").dropna().distinct()
    undefined = s.join(inside, "key").select(F.col("container").alias("file"), "symbol", F.coalesce("language", F.lit("-")).alias("kind"), "weak").distinct()
    declared = inside.join(f, "key").select(F.col("container").alias("file"), F.col("package").alias("library")).distinct()
    return undefined, own, declared


def symbol_resolution(spark: SparkSession, d: str) -> DataFrame:
    return G.resolved_symbols(*_symbols(spark, d))


def library_use(spark: SparkSession, d: str) -> DataFrame:
    undefined, own, declared = _symbols(spark, d)
    return G.library_use(declared, G.resolved_symbols(undefined, own, declared))


def symbol_types(spark: SparkSession, d: str) -> DataFrame:
    f = B.functions(spark, d).where("name is not null")
    return G.symbol_types(f.select(F.substring("name", 1, 4).alias("version"), F.col("name").alias("symbol"), F.col("language").alias("type")))


def symbol_types_narrowed(spark: SparkSession, d: str) -> DataFrame:
    """The names of functions in the files of each version of a package, with the languages as types."""
    s = B.functions(spark, d).where("name is not null").select("key", F.col("name").alias("symbol"), F.col("language").alias("type"))
    f = B.files(spark, d).select("key", "package", "version").dropna().distinct()
    return G.narrowed_types(s.join(f, "key"), s, f)


def match_statistics(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_classes(spark, d).groupBy("class").agg(F.sum("n").alias("n"))


def score_share_others(spark: SparkSession, d: str) -> DataFrame:
    return R.with_others(matching.string_match_rank(spark, d), upto=60.0, least=2.0).withColumn("share", F.round("share", 6))


def version_squash(spark: SparkSession, d: str) -> DataFrame:
    return R.squashed_versions(_files(spark, d).where("package is not null and version is not null"), ["package"])


def json_report(spark: SparkSession, d: str) -> DataFrame:
    unique = matching._of_class("unique")(spark, d).join(matching._classified(spark, d).where("class = 'unique'").select("container", "language", "line", "package"), ["container", "language", "line"])
    return R.nested(matching.string_match_rank(spark, d), unique.select("container", "package", "line", "n"), A.version_histogram(matching._versions(spark, d)))


_PF = "pf AS (SELECT *, lower(trim(checksum, ' ')) AS ck FROM processed_file)"
_TAGS = "t AS (SELECT row_id, coalesce(regexp_matches(pathname, '/tests/'), false) AS test, coalesce(regexp_matches(pathname, '\\.h$'), false) AS header, coalesce(thirdparty, false) AS foreign_ FROM processed_file)"
_RANGES = "r AS (SELECT user_id AS key, event_id AS lo, event_id + floor(value)::BIGINT AS hi FROM events)"
_VKEY = "list_transform(string_split(regexp_extract({v}, '^[0-9]+(?:\\.[0-9]+)*'), '.'), lambda x: try_cast(x AS INTEGER))"
_SYMBOLS = """s AS (SELECT ck, name AS symbol, coalesce(language, '-') AS kind, starts_with(name, '__') AS weak FROM ef WHERE name IS NOT NULL AND ck IS NOT NULL),
  own AS (SELECT DISTINCT package AS library, symbol, kind, weak FROM s JOIN pf USING (ck) WHERE package IS NOT NULL),
  inside AS (SELECT DISTINCT container AS file, ck FROM rc WHERE container IS NOT NULL AND ck IS NOT NULL),
  und AS (SELECT DISTINCT file, symbol, kind, weak FROM s JOIN inside USING (ck)), decl AS (SELECT DISTINCT file, package AS library FROM inside JOIN pf USING (ck) WHERE package IS NOT NULL),
  res AS (SELECT u.file, u.symbol, u.kind, o.library, CASE WHEN u.weak THEN 3 ELSE 1 END + o.weak::INT AS pass FROM und u JOIN decl d USING (file) JOIN own o ON o.library = d.library AND o.symbol = u.symbol AND o.kind = u.kind
    QUALIFY row_number() OVER (PARTITION BY u.file, u.symbol, u.kind ORDER BY pass, o.library) = 1)"""
def _marked_sql(markers: dict[str, tuple[str, ...]]) -> str:
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    words = ", ".join(quoted(w) for ws in markers.values() for w in ws)
    pairs = ", ".join(f"({quoted(m)}, {quoted(w)})" for m, ws in markers.items() for w in ws)
    return f"""WITH w AS (SELECT [{words}] AS ws), t AS (SELECT doc_id, substr(text, 1, length(text) // 2) || ' ' || ws[(doc_id % len(ws))::INT + 1] || ' ' || substr(text, length(text) // 2 + 1) AS t
        FROM documents, w WHERE text IS NOT NULL) SELECT DISTINCT doc_id, marker FROM t JOIN (VALUES {pairs}) AS m(marker, word) ON contains(t, word)"""


_CERT = (*fixed.ENV33_C, *fixed.MSC24_C)
_MARK = " UNION ALL ".join("SELECT DISTINCT {k}, '%s' AS marker FROM {t} WHERE %s" % (m, " OR ".join(f"contains({{c}}, '{w}')" for w in ws)) for m, ws in FORGES.items())

SQL = {
    "duplicate_groups": f"WITH {_PF}, o AS (SELECT DISTINCT ck, pathname FROM pf WHERE ck IS NOT NULL AND pathname IS NOT NULL) SELECT ck, pathname, count(*) OVER (PARTITION BY ck) AS group_size FROM o QUALIFY group_size > 1",
    "dedup_first": f"WITH {_PF} SELECT row_id, CASE WHEN ck IS NULL THEN false ELSE row_number() OVER (PARTITION BY ck ORDER BY coalesce(pathname, ''), row_id) > 1 END AS duplicate FROM pf",
    "tag_gate": f"WITH {_TAGS} SELECT row_id FROM t WHERE (test OR header) AND NOT foreign_",
    "prune_tags": f"WITH {_TAGS} SELECT row_id FROM t WHERE NOT (test OR foreign_)",
    "file_hashes": "SELECT checksum, md5(head) AS md5, sha1(head) AS sha1, sha256(head) AS sha256 FROM source_head WHERE head IS NOT NULL",
    "path_parts": """SELECT row_id, list_last(string_split(pathname, '/')) AS name, CASE WHEN contains(pathname, '/') THEN regexp_replace(pathname, '/[^/]*$', '') ELSE '' END AS dir,
        coalesce(CASE regexp_extract(pathname, '\\.([A-Za-z+]+)$', 1) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EXTENSIONS.items()) + " END, '-') AS language FROM processed_file WHERE pathname IS NOT NULL",
    "path_without_root": """SELECT row_id, CASE WHEN split_part(pathname, '/', 1) <> pathname AND regexp_replace(split_part(pathname, '/', 1), '[+~]dfsg$|\\.orig$|\\.dfsg[12]$', '') IN
        (package || '-' || regexp_replace(version, '[+~]dfsg$|\\.orig$|\\.dfsg[12]$', ''), package || '_' || regexp_replace(version, '[+~]dfsg$|\\.orig$|\\.dfsg[12]$', ''))
        THEN regexp_replace(pathname, '^[^/]*/', '') ELSE pathname END AS path FROM processed_file WHERE pathname IS NOT NULL AND package IS NOT NULL AND version IS NOT NULL""",
    "path_ancestors": """WITH p AS (SELECT row_id, pathname, string_split(pathname, '/') AS s FROM processed_file WHERE pathname IS NOT NULL),
        u AS (SELECT row_id, pathname AS directory FROM p UNION SELECT row_id, array_to_string(s[1:i], '/') || '/' FROM (SELECT row_id, s, unnest(range(1, len(s))) AS i FROM p))
        SELECT directory, count(*) AS n FROM u GROUP BY directory""",
    "range_exclusion": f"WITH {_RANGES}, p AS (SELECT DISTINCT user_id AS key, event_id + 3 AS x FROM events) SELECT key, x, (SELECT max(hi) FROM r WHERE r.key = p.key AND lo <= x AND x < hi) AS until FROM p",
    "range_next": f"WITH {_RANGES} SELECT user_id AS key, event_id AS x, coalesce((SELECT min(lo) FROM r WHERE r.key = e.user_id AND lo > e.event_id), 0) AS start FROM events e",
    "carve_gaps": f"WITH {_RANGES}, g AS (SELECT key, lo, max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r) SELECT key, e AS lo, lo AS hi FROM g WHERE e < lo",
    "clone_containment": f"""WITH {_PF}, o AS (SELECT DISTINCT concat_ws(' ', package, version) AS package, ck FROM pf WHERE version IS NOT NULL AND ck IS NOT NULL), n AS (SELECT package, count(*) AS n FROM o GROUP BY 1),
        s AS (SELECT a.package, b.package AS other, count(*) AS c FROM o a JOIN o b USING (ck) WHERE a.package <> b.package GROUP BY ALL)
        SELECT s.package, other, a.n AS n_keys, b.n AS n_other, CASE WHEN a.n = b.n THEN 'identical' ELSE 'partial' END AS clone FROM s JOIN n a ON a.package = s.package JOIN n b ON b.package = other WHERE c = a.n""",
    "package_hash_counts": f"WITH {_PF} SELECT package, version, count(DISTINCT ck) AS n FROM pf WHERE package IS NOT NULL AND version IS NOT NULL AND ck IS NOT NULL GROUP BY ALL",
    "third_party": f"""WITH {_PF} SELECT DISTINCT a.row_id FROM (SELECT *, regexp_replace(pathname, '/?[^/]*$', '') AS dir FROM pf) a JOIN pf b USING (ck)
        WHERE regexp_matches(dir, '{THIRD_PARTY}') AND a.package <> b.package AND contains(dir, b.package) AND a.package NOT IN ('linux', 'busybox')""",
    "known_files": with_base("SELECT row_id FROM rc WHERE ck IN (SELECT ck FROM pf WHERE ck IS NOT NULL)"),
    "not_in_kb": with_base("SELECT container, count(*) AS n FROM rc WHERE ck IS NOT NULL AND ck NOT IN (SELECT ck FROM pf WHERE ck IS NOT NULL) GROUP BY container"),
    "hash_xref": with_base("SELECT row_id, coalesce(known, filename) AS name FROM rc LEFT JOIN (SELECT ck, min(filename) AS known FROM pf WHERE filename IS NOT NULL AND ck IS NOT NULL GROUP BY ck) USING (ck)"),
    "tree_comparison": with_base("""SELECT DISTINCT filename AS name, ck AS key, CASE WHEN (filename, ck) IN (SELECT (filename, ck) FROM pf WHERE filename IS NOT NULL AND ck IS NOT NULL) THEN 'same'
        WHEN filename IN (SELECT filename FROM pf WHERE filename IS NOT NULL AND ck IS NOT NULL) THEN 'different' ELSE 'missing' END AS state FROM rc WHERE filename IS NOT NULL AND ck IS NOT NULL"""),
    "file2package": with_base("""SELECT container, package, count(*) AS names FROM (SELECT DISTINCT container, regexp_replace(filename, '-\\d+(\\.[^.]*)$', '\\1') AS filename FROM rc WHERE container IS NOT NULL AND filename IS NOT NULL)
        JOIN (SELECT DISTINCT filename, package FROM pf WHERE filename IS NOT NULL AND package IS NOT NULL) USING (filename) GROUP BY ALL"""),
    "rename_merge": """SELECT row_id, package, version FROM (SELECT p.row_id, coalesce(r.newname, p.package) AS package, version, checksum FROM processed p
        LEFT JOIN (SELECT originalname, arg_min_null(newname, row_id) AS newname FROM renames WHERE originalname IS NOT NULL GROUP BY 1) r ON p.package = r.originalname)
        QUALIFY row_number() OVER (PARTITION BY package, version, checksum ORDER BY row_id) = 1""",
    "duplicate_archives": "SELECT lower(trim(checksum, ' ')) AS ck, count(*) AS n FROM processed WHERE checksum IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "new_contents": with_base("SELECT DISTINCT ck FROM rc WHERE ck IS NOT NULL AND ck NOT IN (SELECT ck FROM pf WHERE ck IS NOT NULL)"),
    "version_order": f"SELECT package, version, rank() OVER (PARTITION BY package ORDER BY {_VKEY.format(v='version')}) AS place FROM (SELECT DISTINCT package, version FROM processed_file WHERE package IS NOT NULL AND version IS NOT NULL)",
    "first_version": f"WITH {_PF} SELECT package, ck, version FROM (SELECT DISTINCT package, ck, version FROM pf WHERE package IS NOT NULL AND ck IS NOT NULL AND version IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY package, ck ORDER BY {_VKEY.format(v='version')}, version) = 1",
    "archive_names": """SELECT row_id, regexp_extract(filename, p, 1) AS package, regexp_extract(filename, p, 2) AS version FROM processed, (SELECT '^(.+?)[-_]v?(\\d[^/]*?)(?:\\.src\\.rpm|\\.tar\\.[a-z0-9]+|\\.tgz|\\.zip|\\.jar)$' AS p) WHERE filename IS NOT NULL""",
    "copyright_lines": "SELECT stringidentifier AS line, count(*) AS n FROM extracted_string WHERE contains(lower(stringidentifier), 'copyright') OR contains(lower(stringidentifier), '(c)') OR contains(stringidentifier, '©') GROUP BY 1",
    "shell_invocations": "SELECT '/sbin/' || stringidentifier AS line, count(*) AS n FROM extracted_string WHERE contains(stringidentifier, '%s') OR contains(stringidentifier, '*') GROUP BY 1",
    "urls": """WITH t AS (SELECT row_id, concat_ws(' see ', downloadurl, website, 'http://localhost/x') AS t FROM processed),
        u AS (SELECT DISTINCT row_id, unnest(regexp_extract_all(t, '((?:https?|ftp)://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~%/?&=#-]*)?)')) AS url FROM t)
        SELECT * FROM u WHERE NOT regexp_matches(url, '^[a-z]+://(?:127\\.0\\.0\\.1|192\\.168\\.|10\\.|[^./]+(?:[:/]|$))')""",
    "url_hosts": "SELECT regexp_extract(downloadurl, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS n FROM processed WHERE downloadurl IS NOT NULL GROUP BY 1",
    "emails": """SELECT DISTINCT row_id, 'admin@' || regexp_extract(website, '^https://([A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+)', 1) AS email FROM processed WHERE regexp_matches(website, '^https://[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')""",
    "forge_markers": _MARK.format(k="row_id", t="processed", c="downloadurl"),
    "license_markers": """WITH l AS (SELECT DISTINCT stringidentifier AS line FROM extracted_string) SELECT line, 'contributors' AS marker FROM l WHERE contains(line, 'contributors') OR contains(line, '©')
        UNION ALL SELECT line, 'usage' FROM l WHERE contains(line, 'usage:') UNION ALL SELECT line, 'assertion' FROM l WHERE contains(line, 'assertion')""",
    "licence_words": _marked_sql(fixed.LICENCE_MARKERS),
    "forge_words": _marked_sql(fixed.FORGE_MARKERS),
    "kernel_words": _marked_sql(fixed.KERNEL_MARKERS),
    "cert_calls": f"""WITH h AS (SELECT checksum, string_split(head || chr(10) || [{", ".join(f"'{n}'" for n in _CERT)}][length(head) % {len(_CERT)} + 1] || ' (x);', chr(10)) AS s FROM source_head WHERE head IS NOT NULL),
        l AS (SELECT checksum, unnest(s) AS line, generate_subscripts(s, 1) AS linenumber FROM h)
        SELECT checksum, unnest(regexp_extract_all(line, '\\b({"|".join(_CERT)})\\s*\\(', 1)) AS name, linenumber FROM l""",
    "code_smells": f"""WITH h AS (SELECT checksum, string_split(head, chr(10)) AS s FROM source_head WHERE head IS NOT NULL), l AS (SELECT checksum, unnest(s) AS line, generate_subscripts(s, 1) AS linenumber FROM h)
        SELECT checksum, unnest(regexp_extract_all(line, '\\b({"|".join(SMELLS)})\\s*\\(', 1)) AS name, linenumber FROM l""",
    "login_search": "SELECT c.package AS word, count(*) AS documents FROM documents d JOIN canonical_package c ON contains(d.text, c.package) GROUP BY 1",
    "lcp_provider": with_base(""", f AS (SELECT DISTINCT ck, package, version, pathname AS path FROM pf WHERE ck IS NOT NULL AND package IS NOT NULL AND version IS NOT NULL AND pathname IS NOT NULL),
        o AS (SELECT DISTINCT package, version, name AS symbol, path FROM (SELECT DISTINCT ck, name FROM ef WHERE name IS NOT NULL) JOIN f USING (ck)),
        m AS (SELECT a.*, b.path AS provider, coalesce(list_min([i FOR i IN range(0, greatest(length(a.path), length(b.path))) IF a.path[i + 1] <> b.path[i + 1]]), length(a.path)) AS common
          FROM o a JOIN o b USING (package, version, symbol) WHERE a.path <> b.path)
        SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY package, version, symbol, path ORDER BY common DESC, provider) = 1"""),
    "equivalent_modules": with_base(""", k AS (SELECT ck, list_sort(list(DISTINCT name)) AS m FROM ef WHERE ck IS NOT NULL AND name IS NOT NULL GROUP BY ck)
        SELECT ck, min(ck) OVER w AS group_ck, len(m) AS n_members, count(*) OVER w AS group_size FROM k WINDOW w AS (PARTITION BY m)"""),
    "dependency_closure": """WITH RECURSIVE e AS (SELECT DISTINCT originalname AS src, newname AS dst FROM renames WHERE originalname IS NOT NULL AND newname IS NOT NULL),
        c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON e.src = c.dst WHERE depth < 16) SELECT src, dst, min(depth) AS depth FROM c GROUP BY ALL""",
    "edge_types": """WITH RECURSIVE e AS (SELECT DISTINCT originalname AS src, newname AS dst, CASE WHEN lower(originalname) = lower(newname) THEN 'spelling' ELSE 'rename' END AS kind FROM renames WHERE originalname IS NOT NULL AND newname IS NOT NULL),
        c AS (SELECT src AS start, src FROM e UNION SELECT c.start, e.dst FROM c JOIN e USING (src)) SELECT start AS src, kind, count(*) AS n FROM (SELECT DISTINCT * FROM c) JOIN e USING (src) GROUP BY ALL""",
    "library_resolution": """WITH so AS (SELECT package AS library, min(p) AS path FROM (SELECT package, regexp_extract(filename, '^(.+?)[-_]v?(\\d[^/]*?)(?:\\.src\\.rpm|\\.tar\\.[a-z0-9]+|\\.tgz|\\.zip|\\.jar)$', 1) AS p FROM processed WHERE filename IS NOT NULL AND package IS NOT NULL)
        GROUP BY 1 HAVING count(DISTINCT p) = 1), w AS (SELECT package AS library, package AS path, 0 AS k FROM canonical_package UNION ALL SELECT originalname, newname, 1 FROM renames WHERE newname IS NOT NULL UNION ALL SELECT library, path, 2 FROM so)
        SELECT n.library, arg_min(path, (k, path)) AS path, coalesce(['name', 'link', 'soname'][min(k) + 1], 'unresolved') AS way FROM (SELECT DISTINCT package AS library FROM processed WHERE package IS NOT NULL) n LEFT JOIN w USING (library) GROUP BY n.library""",
    "marker_offsets": " UNION ALL ".join(
        f"SELECT '{n}' AS marker, sum((length(head) - length(replace(head, '{m.decode()}', ''))) // {len(m)})::BIGINT AS n FROM source_head WHERE contains(head, '{m.decode()}') HAVING n > 0"
        for n, m in SIGNATURES.items() if m.isascii() and m.decode().isprintable()
    ),
    "fuzzy_nearest": with_base(""", h AS (SELECT lower(trim(checksum, ' ')) AS ck, list_distinct(string_split(head, chr(10))) AS lines FROM source_head WHERE head IS NOT NULL),
        o AS (SELECT DISTINCT pf.ck AS key, filename AS name, lines FROM pf JOIN h USING (ck) WHERE filename IS NOT NULL),
        m AS (SELECT a.key, b.key AS other, (round(100 - 100 * len(list_intersect(a.lines, b.lines)) / greatest(len(list_distinct(list_concat(a.lines, b.lines))), 1)))::INT AS distance FROM o a JOIN o b USING (name) WHERE a.key <> b.key)
        SELECT key, arg_min(other, (distance, other)) AS other, min(distance) AS distance FROM m WHERE distance < 60 GROUP BY key"""),
    "file_tags": "SELECT checksum AS key, NOT regexp_matches(head, '[^\\x09-\\x0d\\x20-\\x7e]') AS is_text FROM source_head WHERE head IS NOT NULL AND head <> ''",
    "file_strings": """SELECT checksum AS key, count(*) AS n, sum(length(x))::BIGINT AS chars FROM (SELECT checksum, unnest(regexp_extract_all(head, '[\\x20-\\x7e\\t]{5,}')) AS x FROM source_head) GROUP BY 1""",
    "symbol_resolution": with_base(f", {_SYMBOLS} SELECT * FROM res"),
    "library_use": with_base(f", {_SYMBOLS} SELECT file, library, count(symbol) AS symbols, count(symbol) > 0 AS used FROM decl LEFT JOIN res USING (file, library) GROUP BY ALL"),
    "symbol_types": "SELECT substr(functionname, 1, 4) AS version, functionname AS symbol, CASE WHEN count(DISTINCT language) = 1 THEN min(language) WHEN count(DISTINCT language) > 1 THEN 'undecided' ELSE 'unknown' END AS type FROM extracted_function WHERE functionname IS NOT NULL GROUP BY ALL",
    "symbol_types_narrowed": with_base(""", s AS (SELECT ck, name AS symbol, language AS type FROM ef WHERE name IS NOT NULL), f AS (SELECT DISTINCT ck, package, version FROM pf WHERE package IS NOT NULL AND version IS NOT NULL AND ck IS NOT NULL),
        w AS (SELECT DISTINCT package, version, symbol FROM s JOIN f USING (ck)),
        h AS (SELECT package, version, symbol, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'undecided' END AS t FROM s JOIN f USING (ck) WHERE type IS NOT NULL GROUP BY ALL),
        e AS (SELECT symbol, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'undecided' END AS t FROM s WHERE type IS NOT NULL AND ck IS NOT NULL GROUP BY ALL)
        SELECT w.package, w.version, w.symbol, coalesce(h.t, CASE WHEN e.t IS NULL THEN 'unknown' WHEN e.t <> 'undecided' THEN e.t ELSE coalesce(b.t, 'undecided') END) AS type
        FROM w LEFT JOIN h ON h.package = w.package AND h.version = w.version AND h.symbol = w.symbol LEFT JOIN e ON e.symbol = w.symbol
        LEFT JOIN h b ON b.package = w.package AND b.symbol = w.symbol AND contains(w.version, '-') AND b.version = split_part(w.version, '-', 1)"""),
    "match_statistics": with_base("SELECT class, sum(n)::BIGINT AS n FROM classified GROUP BY class"),
    "score_share_others": "WITH k AS (" + matching.SQL["string_match_rank"] + """), b AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY container ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
        SELECT container, CASE WHEN before < 60 AND share >= 2 THEN package ELSE 'others' END AS package, round(sum(share), 6) AS share FROM b GROUP BY ALL""",
    "version_squash": """WITH o AS (SELECT DISTINCT package, regexp_replace(version, '\\.?[^.]*$', '') AS prefix, regexp_extract(version, '([^.]*)$', 1) AS l FROM processed_file WHERE package IS NOT NULL AND version IS NOT NULL),
        g AS (SELECT package, prefix, list_sort(list(l)) AS l FROM o GROUP BY ALL)
        SELECT package, prefix, CASE WHEN prefix = '' THEN '' ELSE prefix || '.' END || CASE WHEN len(l) = 1 THEN l[1] ELSE '{' || array_to_string(l, ', ') || '}' END AS versions FROM g""",
}
QUERIES = {
    f.__name__: f
    for f in (
        duplicate_groups, dedup_first, tag_gate, prune_tags, file_hashes, file_crc32, path_parts, path_without_root, path_ancestors, range_exclusion, range_next, carve_gaps, clone_containment, package_hash_counts,
        third_party, known_files, not_in_kb, hash_xref, tree_comparison, file2package, rename_merge, duplicate_archives, new_contents, version_order, first_version, archive_names, copyright_lines, shell_invocations,
        urls, url_hosts, emails, forge_markers, license_markers, cert_calls, code_smells, login_search, lcp_provider, equivalent_modules, dependency_closure, edge_types, library_resolution, symbol_resolution, library_use,
        symbol_types, symbol_types_narrowed, match_statistics, score_share_others, version_squash, json_report, file_tags, file_strings, marker_offsets, fuzzy_nearest,
    )
} | {"licence_words": _finds(fixed.LICENCE_MARKERS), "forge_words": _finds(fixed.FORGE_MARKERS), "kernel_words": _finds(fixed.KERNEL_MARKERS)}
