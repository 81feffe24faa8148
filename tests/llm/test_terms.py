"""Burst tries, term counts and weights against brute force."""

import math
import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import term_counts
from strandline.llm.burst_trie import BurstTrie
from strandline.llm.distinctive import term_weights
from strandline.llm.term_counts import heavy_prefixes, mark, pair_counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=200), st.integers(1, 5))
def test_trie_counts_like_a_dict(terms, limit):
    trie, want = BurstTrie(limit), Counter()
    for t in terms:
        trie.add(t, 2, 1)
        want[t] += 1
    got = {p + s: tuple(c) for p, held in trie.containers() for s, c in held.items()}
    assert got == {t: (2 * n, n) for t, n in want.items()} and trie.size == len(want)


def _brute(rows):
    occ, rec = Counter(), defaultdict(set)
    for a, b in rows:
        if a is not None and b is not None:
            for field, term, record in ((0, a, b), (1, b, a)):
                occ[field, term.encode()] += 1
                rec[field, term.encode()].add(record)
    return {k: (n, len(rec[k])) for k, n in occ.items()}


def test_pair_counts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "HELD_TERMS", 50)
    rng = random.Random(3)
    words = ["", "the", "then", "thermal" * 30, "ünï", "日本", *(f"the common prefix of {i}" for i in range(40)), *(f"x{i}" for i in range(60)), None]
    rows = [("the", f"r{rng.randrange(40)}") for _ in range(3000)] + [(rng.choice(words), rng.choice([f"r{rng.randrange(30)}", None, ""])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("field", F.lit("clash")).repartition(5)
    got = pair_counts(df, F.col("a").cast("binary"), F.col("b").cast("binary"), routes=6).collect()
    assert {(r.field, bytes(r.term)): (r.occurrences, r.records) for r in got} == _brute(rows) and len(got) == len(_brute(rows))


def test_one_field_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", None)], "a string, r string")
    got = pair_counts(df, F.col("a").cast("binary"), None, F.col("r").cast("binary"))
    assert [(bytes(r.term), r.occurrences, r.records) for r in got.collect()] == [(b"a", 3, 2)]
    assert pair_counts(df.limit(0), F.col("a").cast("binary"), F.col("r").cast("binary")).count() == 0


def test_heavy_prefixes_are_bounded(spark):
    df = spark.createDataFrame([(0, f"prefix{i}".encode()) for i in range(400)] + [(1, b"z")], "field int, term binary")
    heavy = heavy_prefixes(df, 10)
    assert (0, 1, b"p") in heavy and (0, 4, b"pref") in heavy and all(n <= 8 for _, n, _ in heavy) and len(heavy) <= 4 * 10


def test_marks(spark):
    df = spark.createDataFrame([(1,), (2,), (60,)], "records int")
    assert [r["mark"] for r in mark(df, F.col("records") > 50).orderBy("records").collect()] == ["rare", None, "common"]


def test_weights_match_brute_force(spark):
    rng = random.Random(4)
    owned = [(rng.choice(["p", "q", "r", None]), rng.choice([*"abcdefgh", None])) for _ in range(60)]
    held = [(rng.choice([*"abcdefgh", "x", None]), rng.choice(["s", "t", "", "日", None])) for _ in range(300)] + [("a", f"w{i}") for i in range(300)]
    o = {(p, f) for p, f in owned if p and f}
    h = {(f, s) for f, s in held if f and s is not None}
    got = term_weights(spark.createDataFrame(owned, "owner string, file string").withColumn("term", F.lit(1)), spark.createDataFrame(held, "file string, term string").withColumn("owner", F.lit(2)))
    got = {(r.owner, r.term): r for r in got.collect()}
    pairs = Counter((p, s) for p, f in o for g, s in h if f == g)
    assert set(got) == set(pairs)
    owners, files = {p for p, _ in o}, {f for _, f in o}
    for (p, s), n in pairs.items():
        cf, df = sum(v for (_, x), v in pairs.items() if x == s), len({q for q, x in pairs if x == s})
        r = got[p, s]
        assert (r.n_pair, r.n_owner, r.n_files, r.owners) == (n, sum(q == p for q, _ in o), len(files), df)
        assert r.n_term == len({f for f, x in h if x == s and f in files})
        assert math.isclose(r.weight, n * (-math.log2(df / len(owners)) + math.log2(1 - math.exp(-cf / len(owners)))), abs_tol=1e-9)


def test_weights_of_empty_tables(spark):
    o, h = spark.createDataFrame([], "owner string, file string"), spark.createDataFrame([("a", "s")], "file string, term string")
    assert term_weights(o, h).count() == 0 and term_weights(spark.createDataFrame([("p", "a")], o.schema), h.limit(0)).count() == 0
