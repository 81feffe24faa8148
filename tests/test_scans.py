"""The registry and the scans of single files."""

from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.operators import audit, graph, scans


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_registry():
    text = """
[batconfig]
output = x
[gzip]
type = unpack
method = unzip
priority = 1
magic = gzip:xz
noscan = text:graphics
enabled = yes
envvars = A=1:B=x=y
[tar]
type = unpack
method = untar
priority = 7
enabled = yes
[off]
type = leaf
enabled = no
[text]
type = prerun
method = verify
"""
    got = scans.read_registry(text)
    assert [s.name for s in got] == ["text", "tar", "gzip"]
    assert got[2].magic == ("gzip", "xz") and got[2].never == ("text", "graphics") and got[2].settings == {"A": "1", "B": "x=y"}


def test_gates_by_size_and_ending(spark):
    df = spark.createDataFrame([("a.png", 10), ("b.c", 10), ("c.c", 0)], "path string, size long")
    assert rows(scans.scannable(df, ignored=[".png"]), "path") == [("b.c",)] and rows(scans.scannable(df), "path") == [("a.png",), ("b.c",)]


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(scans.kernel_version(lit("x Linux version 2.6.36-rc1 (me@host)"))) == "2.6.36-rc1" and one(scans.kernel_version(lit("none"))) is None
    assert one(scans.busybox_version(lit("BusyBox v1.15.3 (2010)"))) == "1.15.3"
    assert [tuple(x) for x in one(scans.module_parameters(lit("module_param(debug, int, 0644); module_param_named(n, var, bool, 0);")))] == [("debug", "int"), ("n", "bool")]
    assert one(scans.is_certificate(lit("-----BEGIN CERTIFICATE-----\n"))) and not one(scans.is_certificate(lit("-----BEGIN RSA PRIVATE KEY-----\n")))
    assert one(scans.is_private_key(lit("-----BEGIN RSA PRIVATE KEY-----\nx")))


def test_added_lines(spark):
    diff = "--- a/x.c\t2010\n+++ b/x.c\t2011\n@@ -1 +1,2 @@\n-old\n+new\n+++ y.py\n+import os\n keep"
    df = spark.createDataFrame([(1, diff), (2, None), (3, "no diff\n+x")], "key int, text string")
    assert rows(scans.added_lines(df)) == [(1, "x.c", "new"), (1, "y.py", "import os")]


def test_options_and_chunks(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "option string") for xs in (["LS", "CAT", "FEATURE_X"], ["LS", "VI"]))
    assert rows(scans.option_differences(a, b)) == [("CAT", "left"), ("VI", "right")]
    df = spark.createDataFrame([("k", b"abcdefgh"), ("e", b"")], "key string, content binary")
    assert rows(scans.chunks(df, 3, 1)) == [("e", 0, bytearray(b"")), ("k", 0, bytearray(b"abcd")), ("k", 3, bytearray(b"defg")), ("k", 6, bytearray(b"gh"))]


def test_edges_and_markers(spark):
    declared = spark.createDataFrame([("f", "l"), ("g", "l")], "file string, library string")
    undefined = spark.createDataFrame([("f", "s"), ("f", "read"), ("g", "mystery")], "file string, symbol string")
    resolved = spark.createDataFrame([("f", "s", "func", "l", 1)], "file string, symbol string, kind string, library string, pass int")
    known = spark.createDataFrame([("read",), ("write",)], "symbol string")
    got = {(r.file, r.library, r.kind) for r in graph.library_edges(declared, resolved, undefined, known).collect()}
    assert got == {("f", "l", "used"), ("g", "l", "unused"), ("f", None, "knowninterface")}
    texts = spark.createDataFrame([(1, "see http://www.gnu.org/licenses/gpl.txt"), (2, "on github.com"), (3, None)], "k int, t string")
    assert rows(audit.marked(texts, ["k"], "t", fixed.LICENCE_MARKERS)) == [(1, "GNU"), (1, "GPL")]
    assert rows(audit.marked(texts, ["k"], "t", fixed.FORGE_MARKERS)) == [(2, "github.com")]


def test_dispatch_by_registry(spark):
    files = spark.createDataFrame([("a", "x.h", ["header"]), ("b", "y.c", ["test"]), ("c", "z", None)], "key string, path string, tags array<string>")
    listed = [scans.Scan("one", "leaf", "path", 3, never=("test",)), scans.Scan("two", "leaf", "path", 1, only=("test", "header"), settings={"K": "v"}), scans.Scan("early", "prerun", "none")]
    methods = {"path": lambda df, settings: df.select("key", F.lit(settings.get("K", "-")).alias("name"), F.col("path").alias("value"))}
    got = rows(scans.dispatch(files, listed, methods, "leaf"), "scan", "key", "name", "value")
    assert got == [("one", "a", "-", "x.h"), ("one", "c", "-", "z"), ("two", "a", "v", "x.h"), ("two", "b", "v", "y.c")]
    try:
        scans.dispatch(files, listed, methods, "prerun")
    except ValueError as e:
        assert "none" in str(e)
    else:
        raise AssertionError
