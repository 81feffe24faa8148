"""Orphan references and per-key profiles against brute force and in odd cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.keys import checksum_key, checksum_of_key
from strandline.operators.hotkeys import heavy_keys, key_profile, ranks
from strandline.operators.orphans import Validity, orphan_report, orphans
from strandline.operators.skew import hot_keys

DAY = dt.datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def test_orphans_with_validity_match_brute_force(spark):
    rng = random.Random(1)
    refs = [(i, rng.choice(["a", "b", "hot", "hot", "hot", None, ""]), at(rng.choice([None, *range(200)]))) for i in range(600)]
    targets = [(rng.choice(["a", "b", "hot", "c", None]), at(rng.choice([None, *range(150)])), at(rng.choice([None, *range(200)]))) for _ in range(25)]
    r = spark.createDataFrame(refs, "row_id long, k string, t timestamp")
    # A target column named as one of the references must not clash.
    t = spark.createDataFrame(targets, "k string, t timestamp, gone timestamp").withColumn("row_id", F.lit(1))
    r = r.withColumn("__key", F.lit(1)).withColumn("__salt", F.lit("x"))
    found = orphans(r, t, [("k", "k")], validity=Validity("t", "t", "gone"))
    assert found.columns == r.columns
    got = {x.row_id for x in found.collect()}
    want = {i for i, k, x in refs if k is not None and not any(tk == k and f is not None and x is not None and f <= x and (g is None or g > x) for tk, f, g in targets)}
    assert got == want


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_composite_keys(spark, match):
    refs = [(1, "a", 1), (2, "a", 9), (3, None, 1), (4, "z", None), (5, None, None), (6, "a", None)]
    r = spark.createDataFrame(refs, "id int, p string, q int")
    t = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "x string, y int")
    got = {x.id for x in orphans(r, t, [("p", "x"), ("q", "y")], match=match).collect()}
    assert got == {"simple": {2}, "full": {2, 3, 4, 6}, "partial": {2, 4}}[match]


def test_hot_composite_keys_are_salted(spark):
    rows = [(i, "hot", 1) for i in range(400)] + [(i, "cold", i) for i in range(400, 500)]
    r = spark.createDataFrame(rows, "id int, p string, q int")
    t = spark.createDataFrame([("hot", 1), ("cold", 450)], "x string, y int")
    assert {x.id for x in orphans(r, t, [("p", "x"), ("q", "y")]).collect()} == set(range(400, 500)) - {450}
    assert {x.id for x in orphans(r, t.where("x != 'hot'"), [("p", "x"), ("q", "y")]).collect()} == set(range(500)) - {450}


def test_reasons(spark):
    refs = [(1, "a", 5), (2, "a", 15), (3, "a", 25), (4, "b", 1), (5, "none", 5), (6, "a", None), (7, "b", 9)]
    r = spark.createDataFrame([(i, k, at(n), "old") for i, k, n in refs], "id int, k string, t timestamp, why string")
    targets = [("a", at(10), at(20)), ("a", at(10), at(12)), ("b", at(3), dt.datetime(9999, 12, 31)), ("b", None, None), ("none", at(4), at(4))]
    t = spark.createDataFrame(targets, "k string, f timestamp, u timestamp")
    found = orphans(r, t, [("k", "k")], validity=Validity("t", "f", "u"), reason="why")
    assert sorted(found.columns) == sorted(r.columns)
    assert {x.id: x.why for x in found.collect()} == {1: "late", 3: "deleted", 4: "late", 5: "missing", 6: "late"}
    broken = orphans(spark.createDataFrame([(1, "a", None), (2, "a", "c")], "id int, p string, q string"), spark.createDataFrame([("a", "b")], "p string, q string"), [("p", "p"), ("q", "q")], match="full", reason="why")
    assert {x.id: x.why for x in broken.collect()} == {1: "incomplete", 2: "missing"}


def test_a_hot_key_without_target_in_one_month_is_spread(spark):
    r = spark.range(20_000).select("id", F.when(F.col("id") % 20 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"), F.lit(at(3)).alias("t"))
    t = spark.createDataFrame([("hot", at(5), at(9)), ("40", at(0), None)], "k string, f timestamp, u timestamp")
    found = orphans(r, t, [("k", "k")], validity=Validity("t", "f", "u"))
    sizes = [x.n for x in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 19_999
    from strandline.operators import skew

    hashed = r.select(F.xxhash64(F.lit(0), "k").alias("h"), "id")
    hot = hot_keys(hashed, "h")
    parts = skew.salted(hashed, "h", hot, F.col("id"), 8).where(F.col("h").isin(hot)).groupBy(skew.SALT).count().collect()
    assert len(hot) == 1 and len(parts) == 8 and max(x["count"] for x in parts) < 2 * 19_000 / 8


def test_orphans_of_empty_tables(spark):
    r = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, k string")
    none = spark.createDataFrame([], "k string")
    assert [x.id for x in orphans(r, none, [("k", "k")]).collect()] == [1]
    assert orphans(r.limit(0), none, [("k", "k")]).count() == 0
    with pytest.raises(ValueError):
        orphans(r, none, [("k", "k")], match="other")


def test_orphan_report_has_a_month_for_null_times(spark):
    found = spark.createDataFrame([("t", at(0)), ("t", at(1)), ("t", None)], "table_name string, loaded_at timestamp")
    assert {(x.month, x.orphans) for x in orphan_report(found).collect()} == {("2024-01", 2), (None, 1)}


def test_checksum_keys(spark):
    values = [" AB01 ", "ab01", "ab0", "xyz", "XYZ ", "", None, "é", "\tab"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", checksum_key(F.col("v")).alias("k")).withColumn("back", checksum_of_key(F.col("k"))).collect()
    by = {r.v: r for r in rows}
    assert by[" AB01 "].k == by["ab01"].k and by["xyz"].k == by["XYZ "].k and by[None].k is None
    assert all(r.back == r.v.strip(" ").lower() for r in rows if r.v is not None)
    assert len({bytes(r.k) for r in rows if r.k is not None}) == len({v.strip(" ").lower() for v in values if v is not None})


def test_ranks_match_sorting(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(10**12)) for _ in range(3000)] + [("tied", 7)] * 50 + [(rng.choice("xyz"), rng.randrange(-50, 50)) for _ in range(200)] + [("one", -3), (None, 1), ("null", None), ("", 5)]
    df = spark.createDataFrame(rows, "k string, v long")
    fractions = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r.k, r.f): (r.n, r.v) for r in ranks(df, "k", "v", fractions, buckets=8).collect()}
    want = {}
    for k in {k for k, v in rows if k is not None and v is not None}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        want |= {(k, f): (len(own), own[max(1, math.ceil(f * len(own))) - 1]) for f in fractions}
    assert got == want


def test_ranks_without_broadcast(spark, monkeypatch):
    from strandline.operators import hotkeys

    monkeypatch.setattr(hotkeys, "BROADCAST_BYTES", 0)
    rows = [("a", i * i) for i in range(500)] + [("b", i) for i in range(90)]
    got = {r.k: r.v for r in ranks(spark.createDataFrame(rows, "k string, v long"), "k", "v", [0.5], buckets=4).collect()}
    assert got == {"a": 249**2, "b": 44}


def test_profile_of_odd_rows(spark):
    rows = [("a", "r", at(3)), ("a", "r", at(1)), ("a", None, None), ("b", None, None), (None, "r", at(0)), ("", "r", at(2))]
    df = spark.createDataFrame(rows, "k string, r string, t timestamp").withColumn("n_rows", F.lit(0))
    got = {x.k: (x.n_rows, x.n_records, x.first_at) for x in key_profile(df, "k", "r", "t").collect()}
    assert got == {"a": (3, 1, at(1)), "b": (1, 0, None), "": (1, 1, at(2))}
    assert key_profile(df.limit(0), "k", "r", "t").count() == 0
    assert {x.k for x in heavy_keys(key_profile(df, "k", "r", "t"), "k", 5, 2).collect()} == {"a"}


def test_hot_keys(spark):
    df = spark.createDataFrame([("h",)] * 900 + [(str(i),) for i in range(1000)] + [(None,)] * 5000, "k string")
    assert hot_keys(df, "k") == ["h"]
    assert hot_keys(df.limit(0), "k") == []


def test_rows_are_those_of_the_ranks_and_those_without_a_time(spark, monkeypatch):
    from strandline.operators import hotkeys

    df = spark.sql("SELECT * FROM VALUES ('a', 1, timestamp'2024-01-01'), ('a', 2, null), ('a', null, timestamp'2024-01-02'), ('b', 1, null) AS t(k, r, t)")
    assert {x.k: x.n_rows for x in key_profile(df, "k", "r", "t").collect()} == {"a": 3, "b": 1}
    monkeypatch.setattr(hotkeys, "ranks", lambda *a, **k: ranks(*a, **k).withColumn("n", F.col("n") + 10))
    assert {x.k: x.n_rows for x in key_profile(df, "k", "r", "t").collect()} == {"a": 13, "b": 1}
