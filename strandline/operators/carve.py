"""Tagging, carving and extracting from binary files, over a table of (key, path, content)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import formats as B
from strandline.functions import programs as P
from strandline.session import cut

_RUN = re.compile(rb"[\x20-\x7e\t]{5,}")


def _mapped(files: DataFrame, columns: list[str], schema: str, rows_of: Callable) -> DataFrame:
    """Rows that ``rows_of`` gives for each file, a batch of few files at a time, as contents are large."""
    names = [x.split()[0].strip("`") for x in re.split(r",(?![^<]*>)", schema)]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.strip().split(None, 1)[1]] for x in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [r for x in zip(*[c.to_pylist() for c in part.columns]) for r in rows_of(*x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return files.select(*columns).mapInArrow(run, schema)


def tagged(files: DataFrame) -> DataFrame:
    """(key, path, tags): text or binary, and the formats whose checks hold."""
    return _mapped(files, ["key", "path", "content"], "key string, path string, tags array<string>", lambda k, p, c: [(k, p, B.tags_of(p, c))])


def marker_offsets(files: DataFrame) -> DataFrame:
    """(key, marker, offset) of all signatures."""
    return _mapped(files, ["key", "content"], "key string, marker string, offset long", lambda k, c: [(k, n, at) for n, at in B.offsets(c or b"")])


def unpacked(files: DataFrame) -> DataFrame:
    """(parent, format, lo, hi, path, content) of the files inside each file; formats without a decoder here come out
    as found places with a null path and content, and entries of zip files that are too large with a null content."""

    def rows_of(key: str, path: str, content: bytes):
        own = content or b""
        got = B.unpack(own)
        for name, lo, hi, inner in got:
            for child, data in inner:
                yield key, name, lo, hi, f"{path}/{name}-{lo}/{child}", data
        for name, data in (*B.decoded_text(own), *B.restored(own)):
            yield key, name, 0, len(own), f"{path}/{name}-0/{name}", data
        for name, at in B.offsets(own, B.FOUND_ONLY):
            start = at - B.CORRECTIONS.get(name, 0)
            if start >= 0 and len(B.SIGNATURES[name]) >= 4 and not any(lo <= start < hi for _, lo, hi, _ in got):
                yield key, name, start, None, None, None

    return _mapped(files, ["key", "path", "content"], "parent string, format string, lo long, hi long, path string, content binary", rows_of)


def unpacked_all(files: DataFrame, *, depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """(files: key, path, content, level; edges: parent, child, format, lo, hi, path) of a collection and all that is
    inside, level by level until nothing new comes out.

    A content that was met already, at any level, is not unpacked again; each level is cut from its lineage. New
    contents below ``depth`` levels are an error."""
    key = F.sha2("content", 256)
    newest = cut(files.where("content is not null").groupBy(key.alias("key")).agg(F.min("path").alias("path"), F.first("content").alias("content")).withColumn("level", F.lit(0)))
    every, edges = newest, None
    level = 0
    while True:
        level += 1
        inner = cut(unpacked(newest.where("length(content) > 0")).withColumn("child", key))
        step = inner.select("parent", "child", "format", "lo", "hi", "path")
        edges = step if edges is None else edges.unionByName(step)
        fresh = inner.where("content is not null").groupBy(F.col("child").alias("key")).agg(F.min("path").alias("path"), F.first("content").alias("content"))
        newest = cut(fresh.join(every.select("key"), "key", "left_anti").withColumn("level", F.lit(level)))
        if newest.isEmpty():
            return every, edges
        if level > depth:
            raise ValueError(f"there are new contents below {depth} levels")
        every = every.unionByName(newest)


def strings_of(files: DataFrame) -> DataFrame:
    """(key, ordinal, line): printable runs of at least five characters, of Java classes their string constants."""

    def rows_of(key: str, content: bytes):
        own = content or b""
        if own[:4] == b"\xca\xfe\xba\xbe" and (java := P.java_class(own)):
            found = java["strings"]
        elif own[:4] == b"dex\n":
            found = P.dex_strings(own)
        else:
            found = [x.decode("ascii") for x in _RUN.findall(own)]
        return [(key, i, x) for i, x in enumerate(found)]

    return _mapped(files, ["key", "content"], "key string, ordinal long, line string", rows_of)


def symbols_of(files: DataFrame) -> DataFrame:
    """(key, name, binding, kind, defined) of ELF files; names of classes, fields and methods of Java classes."""

    def rows_of(key: str, content: bytes):
        own = content or b""
        if java := P.java_class(own):
            return [(key, java["name"], "global", "class", True), *((key, x, "global", "field", True) for x in java["fields"]), *((key, x, "global", "method", True) for x in java["methods"])]
        return [(key, *s) for s in P.symbols(own)]

    return _mapped(files, ["key", "content"], "key string, name string, binding string, kind string, defined boolean", rows_of)


def libraries_of(files: DataFrame) -> DataFrame:
    """(key, needed, soname, architecture) of ELF files."""
    rows_of = lambda k, c: [(k, *P.dynamic(c), P.architecture(c))] if c and B.elf_header(c) else []
    return _mapped(files, ["key", "content"], "key string, needed array<string>, soname string, architecture string", rows_of)


def modules_of(files: DataFrame) -> DataFrame:
    """(key, field, value) of the information in kernel modules."""
    return _mapped(files, ["key", "content"], "key string, field string, value string", lambda k, c: [(k, *x) for x in P.module_information(c or b"")])


def encrypted_of(files: DataFrame) -> DataFrame:
    """(key, entry, crc) of encrypted entries in zip files."""
    return _mapped(files, ["key", "content"], "key string, entry string, crc long", lambda k, c: [(k, *x) for x in B.encrypted_entries(c or b"")])


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def nearest_by_name(left: DataFrame, right: DataFrame, *, most: int = 60) -> DataFrame:
    """(key, other, distance): for each file (key, name, lines) the file of the same name in ``right`` whose set of
    line hashes is nearest, as percent of lines not shared, if that is below ``most``; ties by key.

    It stands in for a fuzzy digest; ``lines`` is an array of texts, compared on the JVM."""
    a = left.select("name", "key", F.array_distinct("lines").alias("a"))
    b = right.select("name", F.col("key").alias("other"), F.array_distinct("lines").alias("b"))
    shared, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    met = a.join(b, "name").where("key != other").select("key", "other", F.round(100 - 100 * shared / F.greatest(union, F.lit(1))).cast("int").alias("distance"))
    best = met.where(F.col("distance") < most).groupBy("key").agg(F.min(F.struct("distance", "other")).alias("b"))
    return best.select("key", F.col("b.other").alias("other"), F.col("b.distance").alias("distance"))
