"""The transducer, the encoder, the mix and common spans against plain versions."""

import base64
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import mixing, spans
from strandline.llm.spans import class_links, class_sizes, document_pairs, passages, repeated_sentences, shared_spans, shares
from strandline.llm.tokenize import PATTERN, VOCABULARIES, VOCABULARY, Splitter, encode_texts, frequent_words, text_sizes
from strandline.llm.transducer import Transducer, compile_words
from strandline.sources import table

SPLITTER = Splitter()
ODD = [None, "", " ", "\n\n \t", "<|endoftext|> is text", "I'll don't WE'RE", "a\x1cb\x85c d", "日本語テキスト", "🙂🙂 x", "naïve é", "x" * 30_000, "1234567 ½²", "  two  spaces ", "\x00\x01"]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 60_000), max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
def test_transducer_is_the_dict(tmp_path_factory, words, others):
    path = tmp_path_factory.mktemp("t") / "t.bin"
    path.write_bytes(compile_words(words.items()))
    t = Transducer(str(path))
    asked = [*words, *others]
    for w, i in zip(asked, t.index(asked).tolist()):
        assert (i < 0) == (w not in words)
        if i >= 0:
            assert t.ids[t.ends[i] : t.ends[i + 1]].tolist() == words[w]


def test_transducer_shares_suffixes(tmp_path):
    words = [(a + b, [1]) for a in (b"aa", b"bb", b"cc") for b in (b"tion", b"tions")]
    (tmp_path / "t").write_bytes(compile_words(words))
    assert len(Transducer(str(tmp_path / "t"))._keys) <= 6 + 5 + 1


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(os.path.join(VOCABULARIES, VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("words", [0, 40, 65_536])
def test_encoding_is_the_tokenizers(spark, small, reference, words):
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    docs = table(spark, small, "documents").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").unionByName(odd).withColumn("n", F.lit(1))
    want = {r.doc_id: reference.encode_ordinary(r.text) if r.text else [] for r in docs.collect()}
    got = encode_texts(docs, "text", words=words)
    assert got.columns == ["doc_id", "n", "ids"]
    assert {r.doc_id: r.ids for r in got.collect()} == want
    assert {r.doc_id: r.n_ids for r in text_sizes(docs, "text", words=words).collect()} == {k: len(v) for k, v in want.items()}
    back = {k: reference.decode(v) for k, v in want.items()}
    assert all(back[r.doc_id] == (r.text or "") for r in docs.collect())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(st.characters(max_codepoint=0x2200), max_size=40), st.text(" \t\n'aZ9.sté½\u2009\x1c_", max_size=30)))
def test_fast_patterns_split_alike(text):
    import regex

    assert SPLITTER.words(text) == regex.findall(PATTERN, text) == list(SPLITTER.each(text))
    assert "".join(SPLITTER.words(text)) == text


def test_encoding_of_an_empty_table_and_clashes(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(none, "text").count() == 0
    clash = spark.createDataFrame([(1, "a a", "old")], "doc_id long, text string, ids string")
    assert [r.ids for r in encode_texts(clash, "text").collect()] == [[64, 257]]


def test_frequent_words_keep_to_the_limit(spark):
    df = spark.createDataFrame([("a a a a b b c",), (None,), ("",)], "text string")
    assert set(frequent_words(df, 1)) <= {b" a"} and set(frequent_words(df, 100)) == {b"a", b" a", b" b", b" c"}


def _mix_brute(docs, targets, h):
    total = sum(n for _, s, n in docs if s in targets and n is not None)
    out = {}
    for s, (w, most) in targets.items():
        own = sorted(((h[d], n, d) for d, x, n in docs if x == s and n is not None))
        size, most = sum(n for _, n, _ in own), max(0, most or 0)
        budget = (w or 0) * total
        rounds = min(most, int(budget // size)) if size else most
        left = budget - rounds * size
        for _, n, d in own:
            out[d] = rounds
        if rounds < most:
            for _, n, d in own:
                if n > left:
                    break
                left -= n
                out[d] += 1
    return {d: c for d, c in out.items() if c}


@pytest.mark.parametrize("shifts", [(53, 43, 33, 23, 13, 3, 0), (61, 59, 57, 40, 20, 0)])
def test_mix_matches_brute_force(spark, monkeypatch, shifts):
    monkeypatch.setattr(mixing, "_SHIFTS", shifts)
    rng = random.Random(5)
    docs = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "tiny" if i < 40 else "big", "other", None]), rng.choice([0, 1, 5, 50, 400, None])) for i in range(800)]
    targets = {"big": (0.3, 1), "mid": (0.4, 2), "tiny": (0.2, 3), "absent": (0.05, 4), "none": (None, 2), "never": (0.05, None)}
    d = spark.createDataFrame(docs, "doc_id long, source string, n_ids long").withColumn("weight", F.lit(9))
    t = spark.createDataFrame([(s, w, m) for s, (w, m) in targets.items()], "source string, weight double, max_repeat int")
    h = {r.doc_id: r.h for r in d.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(42), "doc_id"), 1).alias("h")).collect()}
    chosen, report = mixing.mix(d, t)
    assert {r.doc_id: r.copies for r in chosen.collect()} == _mix_brute(docs, targets, h)
    got = {r.source: r for r in report.collect()}
    assert set(got) == set(targets)
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-9
    for s, r in got.items():
        assert r.chosen <= r.budget + 1e-6 and (r.shortfall > 0) == r.short
        if r.short and r.documents:
            assert r.chosen == r.available * (r.max_repeat or 0)
    assert got["absent"].short and got["absent"].chosen == 0
    # A larger budget chooses a superset.
    more = {r.doc_id: r.copies for r in mixing.mix(d, t, total=2 * 10**5)[0].collect()}
    assert all(more.get(k, 0) >= c for k, c in _mix_brute(docs, targets, h).items()) or sum(more.values()) < len(more)


def test_mix_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, source string, n_ids long")
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, weight double, max_repeat int")
    chosen, report = mixing.mix(d, t)
    assert chosen.count() == 0 and [(r.source, r.chosen, r.share, r.short) for r in report.collect()] == [("s", 0, None, False)]
    chosen, report = mixing.mix(d, t.limit(0))
    assert chosen.count() == report.count() == 0


def _common(texts, length):
    at, cover, first = defaultdict(set), {}, {}
    for i, t in texts.items():
        for k in range(len(t) - length + 1):
            at[t[k : k + length]].add(i)
    pairs = {(a, b) for own in at.values() for a in own for b in own if a < b}
    for i, t in texts.items():
        own, rep = bytearray(len(t)), bytearray(len(t))
        for k in range(len(t) - length + 1):
            held = at[t[k : k + length]]
            if len(held) > 1:
                own[k : k + length] = b"\1" * length
            if min(held) < i:
                rep[k : k + length] = b"\1" * length
        cover[i], first[i] = sum(own), sum(rep)
    return pairs, cover, first


def test_long_texts_are_winnowed_in_pieces(monkeypatch):
    points = np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint32)
    whole = spans._chosen(points, np.array([3000]), 6, 9, spans.Hasher())
    for chunk in (1, 7, 100, 2999):
        monkeypatch.setattr(spans, "CHUNK", chunk)
        pieces = spans._chosen(points, np.array([3000]), 6, 9, spans.Hasher())
        assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])


@pytest.mark.parametrize("seed, wide, hot", [(1, 32, False), (2, 1, False), (3, 2, True)])
def test_common_spans_match_brute_force(spark, monkeypatch, seed, wide, hot):
    if hot:
        # Every repeated span is taken for a hot one.
        monkeypatch.setattr(spans, "_hot_spans", lambda found: [r.hash for r in found.groupBy("hash").count().where("count > 1").collect()])
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, boiler = [text(18) for _ in range(6)], text(16)
    texts = {}
    for i in range(60):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(20) :], text(rng.randrange(8))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts)), boiler)
        texts[i] = "".join(parts)
    for i in range(60, 80):
        texts[i] = texts[rng.randrange(5)]  # copies
    texts |= {80: "ab" * 200, 81: "ab" * 150, 82: "=" * 300, 83: "-" + "=" * 90, 84: "", 85: "x" * 39}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(86, None)], "doc_id long, text string").withColumn("hash", F.lit(0)).repartition(4)
    classes, members = shared_spans(df, length=40, span=24)
    k = {"length": 40, "span": 24, "wide": wide}
    links = class_links(members, **k)
    got = [tuple(r) for r in document_pairs(classes, links).collect()]
    pairs, cover, first = _common(texts, 40)
    assert len(got) == len(set(got)) and set(got) == pairs
    found = passages(classes, members, df, **k)
    rows = {r.doc_id: r for r in shares(found, df).collect()}
    assert {i: rows[i].shared_chars for i in texts} == cover and rows[86].shared_chars is None
    assert {i: rows[i].repeated_chars for i in texts} == first
    of = {i: min(j for j, u in texts.items() if u == t) for i, t in texts.items()}
    near = {(of[a], of[b]) for a, b in pairs if of[a] != of[b]}
    for r in class_sizes(classes, links).collect():
        assert r.class_id == of[r.doc_id] and r.copies == sum(x == r.class_id for x in of.values())
        assert r.links == len({b for a, b in near if a == r.class_id} | {a for a, b in near if b == r.class_id})


def test_repeated_sentences(spark):
    long = "This sentence stands in both texts and is long. Here is 1.5 of another one! Und noch eine…\nThe last of them all"
    texts = [(1, f"First words. {long}. The end."), (2, f"Other. {long}, but it goes on here. Nothing else."), (3, None), (4, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    classes, members = shared_spans(df, length=60, span=30)
    found = repeated_sentences(passages(classes, members, df, length=60, span=30), df)
    got = [texts[1][1][r["from"] : r["to"]] for r in found.orderBy("from").collect()]
    assert got == ["This sentence stands in both texts and is long.", "Here is 1.5 of another one!", "Und noch eine…"]


def test_a_passage_in_half_of_all_texts(spark):
    """No part of the work grows with the square of the texts that hold one passage, but for the pairs themselves."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    boiler = text(45)
    docs = [(i, f"{text(20)} {boiler} {text(20)}" if i % 2 else text(60)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    classes, members = shared_spans(df)
    rows = {r.doc_id: r for r in shares(passages(classes, members, df), df).collect()}
    assert all(rows[i].shared_chars >= len(boiler) if i % 2 else rows[i].shared_chars == 0 for i, _ in docs)
    assert rows[1].repeated_chars == 0 and rows[3].repeated_chars >= len(boiler)
    assert class_links(members).count() == 1500 * 1499 // 2


def test_spans_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for df in (none, spark.createDataFrame([(1, None), (2, "")], none.schema)):
        classes, members = shared_spans(df)
        assert document_pairs(classes, class_links(members)).count() == 0 == class_sizes(classes, class_links(members)).count()
        found = passages(classes, members, df)
        assert found.count() == 0 == repeated_sentences(found, df).count() and shares(found, df).count() == df.count()


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(0)
    for sizes in ([300], [40, 41, 90], [64]):
        h = rng.integers(0, 50, sum(sizes)).astype(np.uint64) << np.uint64(40)
        ends = np.cumsum(sizes)
        at = set(spans.winnowed(h, 10, ends, 5).tolist())
        start = 0
        for end in ends:
            for i in range(start, end - 5 - 10 + 2):
                assert at & set(range(i, i + 10)), (i, sizes)
            start = end
        assert all(x + 5 <= ends[np.searchsorted(ends, x, "right")] for x in at)
