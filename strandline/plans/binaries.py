"""Queries over binary files: checks, unpacking, carving and extraction, on files that are made around the tables' texts.

No table holds binaries, so each document's text is packed into the format first; what comes out again is then known, and
SQL can say it from the texts alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import formats as B
from strandline.functions import packing as K
from strandline.operators import carve as V
from strandline.operators import knowledge as KB
from strandline.operators import match as M
from strandline.plans import base as P
from strandline.plans.base import with_base
from strandline.sources import table

#: What lies in front of a packed text and behind it.
BEFORE, BEHIND = b"\xee" * 7, b"!!"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null and text != ''").select(F.col("doc_id").cast("string").alias("key"), F.col("text"))


def _made(rows: DataFrame, path: str, write: Callable[..., bytes]) -> DataFrame:
    """(key, path, content): for each row (key, ...) the file that ``write`` makes of its other columns."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys, *rest = (c.to_pylist() for c in part.columns)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([path] * len(keys)), pa.array([write(*x) for x in zip(*rest)], pa.binary())], ["key", "path", "content"])

    return rows.mapInArrow(make, "key string, path string, content binary")


def _padded(name: str, write: Callable[[bytes], bytes]) -> Callable[[str], bytes]:
    before, behind = b"" if name in B.AT_START else BEFORE, b"" if name == "compress" else BEHIND
    return lambda text: before + write(text.encode()) + behind


def _unpacks(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        files = _made(_texts(spark, d), "f", _padded(name, K.CONTAINERS[name]))
        out = V.unpacked(files).where((F.col("format") == name) & F.col("content").isNotNull())
        return out.select(F.col("parent").alias("doc_id"), "lo", F.md5("content").alias("md5"))

    return query


def _decodes(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Whole contents: texts of at least 16 characters, as shorter ones may look like other things."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        write = K.ENCODED[name]
        files = _made(_texts(spark, d).where("length(text) >= 16"), "f", lambda text: write(text.encode()))
        out = V.unpacked(files).where(F.col("format") == name)
        if name in ("byteswap", "xor"):
            inner = V.unpacked(out.select(F.col("parent").alias("key"), "path", "content"))
            out = inner.where("format = 'gzip'")
        return out.select(F.col("parent").alias("doc_id"), F.md5("content").alias("md5"))

    return query


def _carves(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        files = _made(_texts(spark, d), "f", _padded(name, K.CARVED[name]))
        out = V.unpacked(files).where((F.col("format") == name) & (F.col("lo") <= len(BEFORE)))
        return out.select(F.col("parent").alias("doc_id"), "lo", "hi")

    return query


def _checks(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        path, write = K.CHECKED[name]
        one = lambda f: V.tagged(_made(_texts(spark, d), path, f)).select(F.col("key").alias("doc_id"), F.array_contains("tags", name).alias("holds"))
        whole, broken = one(lambda t: write(t.encode())), one(lambda t: K.spoilt(name, write(t.encode())))
        return whole.withColumnRenamed("holds", "whole").join(broken.withColumnRenamed("holds", "broken"), "doc_id")

    return query


def unpack_nested(spark: SparkSession, d: str) -> DataFrame:
    """Texts in a gzip file in an image in an archive, to the end."""
    write = lambda t: K.CONTAINERS["zip"](K.CONTAINERS["squashfs2"](K.CONTAINERS["gzip"](t.encode())))
    files, _ = V.unpacked_all(_made(_texts(spark, d), "f.zip", write))
    return files.where("level = 3").select(F.md5("content").alias("md5"))


def marker_search(spark: SparkSession, d: str) -> DataFrame:
    """Places of the signature of a gzip file behind each text."""
    files = _made(_texts(spark, d), "f", lambda t: t.encode() + b"\x1f\x8b\x08" + t.encode() + b"hsqs")
    return V.marker_offsets(files).where("marker in ('gzip', 'squashfs2')").select(F.col("key").alias("doc_id"), "marker", "offset")


def program_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a program for each file, which defines the functions of the file."""
    names = P.functions(spark, d).where("key is not null and name is not null and name != ''").groupBy(F.hex("key").alias("k")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    found = V.symbols_of(_made(names, "a.out", K.program))
    return found.where("defined and binding = 'global'").groupBy("name").agg(F.count(F.lit(1)).alias("files"))


def program_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Libraries that a program for each RPM needs: the names of the files in it."""
    inside = P.contents(spark, d).select("container", "filename").where("container is not null and filename is not null").groupBy("container").agg(F.array_sort(F.collect_set("filename")).alias("names"))
    found = V.libraries_of(_made(inside.select("container", "names"), "a.so", lambda names: K.program([], names, "own.so")))
    return found.select(F.col("key").alias("container"), F.explode("needed").alias("needed"), "soname", "architecture")


def module_information(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processed").select(F.col("row_id").cast("string"), F.coalesce("version", F.lit("")), F.coalesce("filename", F.lit("")))
    write = lambda version, name: K.program([], [], "", [("version", version), ("license", "GPL"), ("description", name)])
    return V.modules_of(_made(rows, "a.ko", write)).select(F.col("key").alias("row_id"), "field", "value")


def java_members(spark: SparkSession, d: str) -> DataFrame:
    """Methods and string constants of a Java class for each file."""
    names = P.functions(spark, d).where("key is not null and name is not null").groupBy(F.hex("key").alias("k")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    files = _made(names, "B.class", lambda xs: K.java_class("org.example.Own", xs, xs))
    methods = V.symbols_of(files).where("kind = 'method'").select("key", "name", F.lit("method").alias("kind"))
    both = methods.unionByName(V.strings_of(files).select("key", F.col("line").alias("name"), F.lit("string").alias("kind")))
    return both.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("files"))


def binary_match_classes(spark: SparkSession, d: str) -> DataFrame:
    """From bytes to matches: the lines of each RPM's files in a program, packed, found again, and matched. Only lines that
    are printable throughout can be told from what surrounds them."""
    plain = P.identifiers(spark, d).where(F.col("line").rlike(r"\A[\x20-\x7e]{5,}\z") & F.col("language").isNotNull() & F.col("container").isNotNull())
    files = plain.groupBy(F.concat_ws("/", "container", "language", F.floor(F.col("ordinal") / 4096)).alias("key")).agg(F.collect_list("line").alias("lines"))
    packed = _made(files, "fw.cpio", lambda lines: K.CONTAINERS["gzip"](K.CONTAINERS["cpio1"](b"\x00\x01".join(x.encode() for x in lines))))
    # The packed files are unpacked level by level; their keys are led through by the parents.
    one = V.unpacked(packed).where("format = 'gzip'").select(F.col("parent").alias("key"), "path", "content")
    two = V.unpacked(one).where("format = 'cpio1'").select(F.col("parent").alias("key"), "path", "content")
    found = V.strings_of(two).select(F.split("key", "/").alias("k"), "line").select(F.col("k")[0].alias("container"), F.col("k")[1].alias("language"), "line")
    cache = KB.identifier_cache(P.strings(spark, d), P.files(spark, d))
    return M.classify(M.lines_of(found), cache).select("container", "language", "line", "n", "class")


_DOCS = "FROM documents WHERE text IS NOT NULL AND text <> ''"
_N = "octet_length(encode(text))"
#: Sizes of the carved formats by that of the text.
_SIZES = {
    "png": f"57 + {_N}", "gif89": f"17 + {_N} + ceil({_N} / 255.0)::BIGINT", "jpeg": f"4 + {_N} + 4 * ceil({_N} / 60000.0)::BIGINT", "bmp": f"26 + {_N}", "riff": f"12 + {_N}", "aiff": f"12 + {_N}", "ogg": f"{_N} + 28 * ceil({_N} / 255.0)::BIGINT", "pdf": f"16 + {_N}",
    "otf": f"28 + ({_N} + 3) // 4 * 4", "ttf": f"28 + ({_N} + 3) // 4 * 4", "woff": f"44 + {_N}", "elf": f"128 + {_N}", "swf": f"14 + {_N} + 5 * greatest(1, ceil({_N} / 65535.0)::BIGINT)", "ico": f"22 + {_N}", "icc": f"128 + {_N}", "java": f"33 + {_N} + 3 * ceil({_N} / 60000.0)::BIGINT",
}
_START = lambda n: 0 if n in B.AT_START else len(BEFORE)
_FUNCTIONS = "f AS (SELECT DISTINCT ck, name FROM ef WHERE ck IS NOT NULL AND name IS NOT NULL)"

QUERIES = {f.__name__: f for f in (unpack_nested, marker_search, program_symbols, program_libraries, module_information, java_members, binary_match_classes)}
QUERIES |= {f"unpack_{n.replace('-', '_')}": _unpacks(n) for n in K.CONTAINERS} | {f"decode_{n}": _decodes(n) for n in K.ENCODED} | {f"carve_{n}": _carves(n) for n in K.CARVED} | {f"check_{n}": _checks(n) for n in K.CHECKED}
SQL = {f"unpack_{n.replace('-', '_')}": f"SELECT doc_id::VARCHAR AS doc_id, {_START(n)}::BIGINT AS lo, md5(text) AS md5 {_DOCS}" for n in K.CONTAINERS}
SQL |= {f"decode_{n}": f"SELECT doc_id::VARCHAR AS doc_id, md5(text) AS md5 {_DOCS} AND length(text) >= 16" for n in K.ENCODED}
SQL |= {f"carve_{n}": f"SELECT doc_id::VARCHAR AS doc_id, {_START(n)}::BIGINT AS lo, ({_START(n)} + {_SIZES[n]})::BIGINT AS hi {_DOCS}" for n in K.CARVED}
SQL |= {f"check_{n}": f"SELECT doc_id::VARCHAR AS doc_id, true AS whole, false AS broken {_DOCS}" for n in K.CHECKED}
SQL |= {
    "unpack_nested": f"SELECT DISTINCT md5(text) AS md5 {_DOCS}",
    "marker_search": f"SELECT doc_id::VARCHAR AS doc_id, 'gzip' AS marker, {_N}::BIGINT AS offset {_DOCS} UNION ALL SELECT doc_id::VARCHAR, 'squashfs2', (2 * {_N} + 3)::BIGINT {_DOCS}",
    "program_symbols": with_base(f", {_FUNCTIONS} SELECT name, count(*) AS files FROM f WHERE name <> '' GROUP BY name"),
    "program_libraries": with_base("SELECT DISTINCT container, filename AS needed, 'own.so' AS soname, 'x86-64' AS architecture FROM rc WHERE container IS NOT NULL AND filename IS NOT NULL"),
    "module_information": """SELECT row_id::VARCHAR AS row_id, 'version' AS field, coalesce(version, '') AS value FROM processed UNION ALL SELECT row_id::VARCHAR, 'license', 'GPL' FROM processed
        UNION ALL SELECT row_id::VARCHAR, 'description', coalesce(filename, '') FROM processed""",
    "java_members": with_base(f", {_FUNCTIONS} SELECT name, kind, count(*) AS files FROM f, (SELECT unnest(['method', 'string']) AS kind) GROUP BY ALL"),
    "binary_match_classes": with_base("SELECT container, language, line, n, class FROM classified WHERE regexp_full_match(line, '[\\x20-\\x7e]{5,}') AND container IS NOT NULL"),
}
