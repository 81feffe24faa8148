"""Readers of the catalogue formats, and streams."""

import datetime as dt
import gzip
import json

from strandline import streaming
from strandline.sources import formats as S


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_lists(spark, tmp_path):
    (tmp_path / "LIST").write_text("p\t1\tp-1.tgz\to\nq\t2\tq-2.tgz\to\n")
    (tmp_path / "URLS").write_text("http://a/p-1.tgz\thttp://a\n")
    (tmp_path / "REWRITE").write_text("p 1 p-1.tgz o abc newp 1.1\n\n")
    packages = S.package_list(spark, f"{tmp_path}/LIST")
    assert rows(packages) == [("p", "1", "p-1.tgz", "o"), ("q", "2", "q-2.tgz", "o")]
    assert rows(S.download_urls(spark, f"{tmp_path}/URLS")) == [("http://a/p-1.tgz", "http://a")]
    assert rows(S.rewritten(packages, S.rewrite_list(spark, f"{tmp_path}/REWRITE")), "package", "version") == [("newp", "1.1"), ("q", "2")]


def test_hash_manifest(spark, tmp_path):
    (tmp_path / "SUMS").write_text("filename sha256 md5\na.tgz aa bb\nb.tgz cc dd\n")
    assert rows(S.hash_manifest(spark, f"{tmp_path}/SUMS")) == [("a.tgz", "md5", "bb"), ("a.tgz", "sha256", "aa"), ("b.tgz", "md5", "dd"), ("b.tgz", "sha256", "cc")]
    (tmp_path / "none").write_text("")
    assert S.hash_manifest(spark, f"{tmp_path}/none").count() == 0


def test_distribution_contents(spark, tmp_path):
    with gzip.open(tmp_path / "Contents.gz", "wt") as f:
        f.write("This is a list\nFILE    LOCATION\nbin/ls        utils/coreutils\nusr/share/a file   x/p,y/q\n")
    assert rows(S.distribution_contents(spark, f"{tmp_path}/Contents.gz")) == [("a file", "usr/share", "p"), ("a file", "usr/share", "q"), ("ls", "bin", "coreutils")]


def test_scan_results_and_binaries(spark, tmp_path):
    (tmp_path / "scan.json").write_text(json.dumps([{"name": "f", "path": "/", "tags": ["elf"], "size": 3, "scans": [{"offset": 0, "scanname": "gzip", "scanreports": ["a"]}]}]))
    got = S.scan_results(spark, f"{tmp_path}/scan.json").first()
    assert got.tags == ["elf"] and got.scans[0].scanreports == ["a"] and got.checksum is None
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"abc")
    assert [(r.size, len(r.key)) for r in S.binary_files(spark, f"{tmp_path}/d").collect()] == [(3, 64)]


def test_vulnerabilities(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<nvd xmlns:vuln="http://v"><entry id="CVE-1"><vuln:vulnerable-software-list><vuln:product>cpe:/a:v:p:1</vuln:product><vuln:product>cpe:/a:v:p:2</vuln:product></vuln:vulnerable-software-list></entry></nvd>'
    )
    got = S.vulnerabilities(spark, f"{tmp_path}/feed.xml")
    assert rows(got) == [("CVE-1", "v", "p", "1"), ("CVE-1", "v", "p", "2")]
    cves = spark.createDataFrame([("CVE-1", "p", "1", "net/a.c")], "cve string, product string, version string, path string")
    files = spark.createDataFrame([("p", "1", "p-1/net/a.c", "k"), ("p", "1", "p-1/b.c", "l"), ("p", "2", "net/a.c", "m")], "package string, version string, pathname string, key string")
    assert rows(S.vulnerable_files(cves, files)) == [("CVE-1", "k", "p-1/net/a.c")]


def test_schemas_make_tables(spark):
    from strandline.sources import formats as S

    for statement in S.schemas():
        spark.sql(statement.replace("EXISTS ", "EXISTS made_"))
    assert set(spark.table("made_licenses").columns) == {"checksum", "license", "scanner", "version"}
    for name in S.SCHEMAS:
        spark.sql(f"DROP TABLE made_{name}")


def test_late_rows_of_a_stream(spark, tmp_path):
    """What comes later than the watermark allows is dropped; duplicates within it are told across batches."""
    at = lambda day: dt.datetime(2024, 1, day)
    for k, rows_ in enumerate(([("a", at(1)), ("b", at(9))], [("b", at(9)), ("c", at(1)), ("d", at(9))], [("e", at(20))])):
        spark.createDataFrame(rows_, "k string, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
        streaming.run_once(streaming.first_seen(stream, "k", "ts", "1 day"), f"{tmp_path}/seen", f"{tmp_path}/state")
    # c came eight days after its time, when only one day was allowed.
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/seen").collect()) == ["a", "b", "d", "e"]


def test_streams(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    data = [("a", at(0), 1.0), ("a", at(0.2), 2.0), ("b", at(0.3), 4.0), ("a", at(5), 1.0)]
    df = spark.createDataFrame(data, "k string, ts timestamp, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    streaming.run_once(streaming.first_seen(stream(), "k", "ts"), f"{tmp_path}/seen", f"{tmp_path}/c1")
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/seen").collect()} == {"a", "b"}
    streaming.run_once(streaming.counts_by_window(stream(), "k", "ts"), f"{tmp_path}/win", f"{tmp_path}/c2", "complete")
    assert rows(spark.read.parquet(f"{tmp_path}/win"), "k", "n", "total") == [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 4.0)]
    streaming.run_once(streaming.sessions(stream(), "k", "ts"), f"{tmp_path}/ses", f"{tmp_path}/c3", "complete")
    assert rows(spark.read.parquet(f"{tmp_path}/ses"), "k", "n") == [("a", 1), ("a", 2), ("b", 1)]


def test_source_trees_and_file_lists(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "README").write_text("no")
    assert [(r.language, r.text) for r in S.source_files(spark, f"{tmp_path}/src").collect()] == [("Python", "x = 1")]
    df = spark.createDataFrame([("p", "/bin", "a/b//c")], "package string, directory string, filenames string")
    assert rows(S.package_file_list(df)) == [("a", "/bin", "p"), ("b", "/bin", "p"), ("c", "/bin", "p")]
