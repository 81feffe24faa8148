"""Names, garbled text and files of other hands: small truths and held-out accuracy."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import canonical, handwritten
from strandline.llm.canonical import BKTree, Pattern, forms, map_names, match_names
from strandline.llm.handwritten import names_of, not_handwritten
from strandline.llm.mojibake import candidates, garbled_rows


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


words = st.text(alphabet="abcdé", max_size=9)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_distance_is_levenshteins(a, b):
    assert Pattern(a).distance(b) == _levenshtein(a, b)


@settings(max_examples=40, deadline=None)
@given(st.lists(words, max_size=40), words, st.integers(0, 3))
def test_tree_finds_all_within(texts, asked, radius):
    got = BKTree(texts).within(asked, radius)
    assert sorted(got) == sorted({(d, t) for t in texts if (d := _levenshtein(asked, t)) <= radius})


def test_forms():
    for typed in ("ZLIB", "zlib-1.2.3.tar.gz", "the zlib project", '"zlib"', " zlib ", "zlib_1.2", "zlib (1.2)", "zlib v1.2", "zlib.orig", "zlib-1.2+dfsg", "zlib-dev", "py-zlib", "libzlib", "org.zlib.zlib", "ｚｌｉｂ", "zlíb", "zlіb"):
        assert "zlib" in forms(typed), typed
    assert forms("") == [] and forms(" ... ") == []


@pytest.fixture(scope="module")
def reference(spark):
    entries = [(1, "openssl"), (2, "openssl-utils"), (3, "libpng"), (4, "png"), (5, "busybox"), (6, "dropbear")]
    return spark.createDataFrame(entries, "entry_id long, entry string")


def test_names_and_renames(spark, reference):
    renames = [(1, "oldssl", "OpenSSL 1.0"), (2, "oldssl", "busybox"), (3, "older", "oldsl"), (4, "loop1", "loop2"), (5, "loop2", "loop1"), (6, "gone", None), (7, "BusyBox", "busybox"), (8, "deadend", "nowhere at all"), (9, None, "png")]
    r = spark.createDataFrame(renames, "row_id long, old string, new string")
    want = {
        "openssl": 1, "OPENSLL": 1, "openssl-utils": 2, "openssl_utls": 2, "openssl-dev": 1, "libpng": 3, "png": 4, "py-png": 4, "oldssl": 1, "OLDSSL-2.0": 1, "olddsl": 1, "older": 1, "loop1": 0, "gone": 0,
        "busybox": 5, "BusyBox": 5, "deadend": 0, "": 0, "???": 0, "completely different": 0, "dropbear" + " ": 6,
    }
    values = spark.createDataFrame([(i, n) for i, n in enumerate([*want, *want, None])], "id long, name string").withColumn("entry", F.lit("clash")).withColumn("entry_id", F.lit("old"))
    got = map_names(values, "name", reference, r).collect()
    assert len(got) == 2 * len(want) + 1
    assert {x["name"]: x.entry_id for x in got} == want | {None: None}


def test_shards_agree_with_the_whole(spark, monkeypatch):
    monkeypatch.setattr(canonical, "GROUP_NAMES", 20)
    rng = random.Random(6)
    names = ["".join(rng.choice("abcde") for _ in range(8)) for _ in range(60)]
    typed = [n[:k] + rng.choice("abcde") + n[k + 1 :] for n in names for k in (2, 5)] + ["zzzzzzzz", ""]
    n, e = spark.createDataFrame([(t,) for t in typed], "name string"), spark.createDataFrame([(x,) for x in names], "entry string")
    one, many = ({r["name"]: (r.entry, r.distance) for r in match_names(n, e, **k).collect()} for k in ({}, {"whole": 10, "shard": 7}))
    assert one == many and one["zzzzzzzz"] == (None, None)


def test_shards_prefer_the_folded_spelling(spark):
    n, e = spark.createDataFrame([("FOO",), ("bazaas",)], "name string"), spark.createDataFrame([(x,) for x in ("Foo", "foo", "Bazaar", "bazaat")], "entry string")
    for k in ({}, {"whole": 1, "shard": 1}):
        assert {r["name"]: (r.entry, r.distance) for r in match_names(n, e, **k).collect()} == {"FOO": ("foo", 0), "bazaas": ("bazaat", 1)}


def test_chains_by_doubling_agree_with_following(spark):
    rng = random.Random(7)
    nodes = [f"n{i:02}" for i in range(60)]
    chains = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("x", None), ("self", "self"), ("y", "x")]
    for seed in range(3):
        rng = random.Random(seed)
        step = {k: rng.choice([*nodes, None]) for k in rng.sample(nodes, 45)} | dict(chains)
        own = [(k, i + 1) for i, k in enumerate([*rng.sample(nodes, 8), "c40", *["self"][: seed % 2]])]
        s, ids = spark.createDataFrame(list(step.items()), "k string, at string"), spark.createDataFrame(own, "k string, id long")
        one, two = ({r.k: r.linked for r in f(s, ids).collect()} for f in (canonical._followed, canonical._doubled))
        assert one == two and len(one) == len(step) and one["c00"] == dict(own)["c40"] and one["y"] == 0


def test_names_of_empty_tables(spark, reference):
    r = spark.createDataFrame([], "row_id long, old string, new string")
    v = spark.createDataFrame([("png",)], "name string")
    assert map_names(v.limit(0), "name", reference, r).count() == 0
    assert [x.entry_id for x in map_names(v, "name", reference.limit(0), r).collect()] == [0]


CLEAN = ["Größe der Datei {} ist ungültig", "Schlüssel {} gehört nicht hierher", "añadir la sección {} está vacío", "é preciso fechar a conexão {}", "le périphérique {} a été retiré", "Ошибка чтения {}", "файл {} не найден", "Σφάλμα στο αρχείο {}", "無効な値です {}", "文件 {} 已损坏", "AÇÃO {} JÁ CONCLUÍDA", "AMANHÃ… {}"]


def _names(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]


def test_garbled_text_is_found_and_restored(spark):
    rng = random.Random(8)
    clean = [(t.format(n)) for t in CLEAN for n in _names(t, 40)]
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "cp1252")]
    bad = {}
    for t in rng.sample(clean, 150):
        meant, seen = rng.choice(chains)
        try:
            g = t.encode(meant).decode(seen)
        except UnicodeError:
            continue
        if g != t:
            bad[g] = t
    twice = clean[0].encode().decode("cp1252").encode().decode("latin-1")
    part = clean[0][:20] + clean[0][20:].encode().decode("latin-1") + " größe".encode().decode("latin-1")
    bad |= {twice: clean[0], part: clean[0] + " größe"}
    lost = ["Gr��e der Datei", "x\x81y"]
    rows = [*clean, *bad, *lost, None, "", "plain ascii ??? text", "x" * 20_000, clean[5], clean[5]]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id long, v string").withColumn("value", F.lit(1))
    got = {r.row_id: r for r in garbled_rows(df, "v").collect()}
    found = {r.v: r.restored for r in got.values()}
    assert not set(found) & set(clean), set(found) & set(clean)
    assert set(lost) <= set(found) and len([r for r in got.values() if r.v == clean[5]]) == 0
    hit = [g for g in bad if g in found]
    assert len(hit) >= 0.95 * len(bad)
    assert sum(found[g] == bad[g] for g in hit) >= 0.95 * len(hit)


def test_garbled_text_of_empty_tables(spark):
    df = spark.createDataFrame([], "row_id long, v string")
    assert garbled_rows(df, "v").count() == 0
    assert garbled_rows(spark.createDataFrame([(1, "only ascii"), (2, None)], df.schema), "v").count() == 0
    assert garbled_rows(df.withColumn("chain", F.lit(1)), "v").columns == ["row_id", "v", "restored", "chain"]


def test_right_texts_beside_many_damaged_ones(spark):
    """Damaged copies of one pattern in the collection do not make the right texts of the pattern look damaged."""
    words = [w[:6] for w in _names(3, 240)]
    right = [f"Datei für {w} nicht gefunden" for w in words]
    bad = [t.encode("cp1252").decode("cp850") for t in right[:30]] + [t.encode().decode("cp1252") for t in right[30:60]]
    df = spark.createDataFrame(list(enumerate([*right, *bad])), "row_id long, v string")
    found = {r.v for r in garbled_rows(df, "v").collect()}
    assert not found & set(right) and len(found & set(bad)) >= 55


def test_line_end_of_c1_is_no_damage(spark):
    df = spark.createDataFrame([(1, "größe\x85"), (2, "gr\x81"), (3, "größe")], "row_id long, v string")
    assert {r.row_id for r in garbled_rows(df, "v").collect()} == {2}


def test_repeated_damage_is_undone():
    thrice = "größe"
    for _ in range(3):
        thrice = thrice.encode().decode("cp1252")
    assert "größe" in candidates(thrice)


def test_candidates_hold_the_original():
    assert "größe" in candidates("größe".encode().decode("cp1252"))
    assert "größe" in candidates("größe".encode().decode("latin-1").encode().decode("cp1252"))
    assert "Öffnen" in candidates("Öffnen".encode("cp1252").decode("cp850"))
    assert candidates("plain") == {}


def test_names_in_heads():
    assert names_of("int alpha = beta(1, 0x4a); // gamma\n", "c")[0] == ["int", "alpha", "beta"]
    assert names_of("alpha = 'beta' # gamma\n", "python")[0] == ["alpha"]


CODE = "static int {0}_buffer(struct queue *p, int {1})\n{{\n\tif (!{1}->cache)\n\t\treturn -3;\n\tread_{0}(&p->window, {1});\n\t/* {0} must come first */\n}}\n"


def test_limits_are_of_all_held_out_heads(spark):
    text = lambda i, k: "\n".join(f"int {w}_{k}{i} = read_{w}(value);" for w in ("alpha", "buffer", "cursor", "record"))
    heads = [(f"{x}{i}", x, text(i, k)) for x, k, n in (("c", "of", 400), ("ruby", "in", 200)) for i in range(n)]
    df = spark.createDataFrame(heads, "key string, language string, head string").withColumn("tool", F.lit(False))
    some, every = handwritten.fit(df, most=30), handwritten.fit(df)
    # The density does not depend on the models.
    assert set(some.poor) == {"", "c", "ruby"} and some.poor == pytest.approx(every.poor)


def test_models_and_limits_leave_out_one_head_at_a_time(spark):
    """The limits are those of every clean head under the counts of all others of its language; no head is kept from either."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdehinorst_") for _ in range(rng.randrange(3, 9)))
    text = lambda: "\n".join(f"{word()} = {word()}({word()});" for _ in range(6)) + "\n"
    heads = [(f"{x}{i}", x, text(), False) for x, n in (("c", 30), ("java", 24), ("go", 5), ("", 3)) for i in range(n)]
    limits = handwritten.fit(spark.createDataFrame(heads, "key string, language string, head string, tool boolean"))
    grams = [handwritten._grams(names_of(h, x)[0])[0] for _, x, h, _ in heads]
    bins = handwritten._SIZE**3
    total = lambda own: sum(np.bincount(g, minlength=bins) for (_, x, _, _), g in zip(heads, grams) if own in ("", x))
    # Languages of few heads are measured by the model of all, in which those without a language count once.
    cost = [handwritten.NameModel(total(x if x in ("c", "java") else "") - np.bincount(g, minlength=bins)).cost(g).mean() for (_, x, _, _), g in zip(heads, grams)]
    want = {own: np.mean(e) + handwritten.DEVIATIONS * max(np.std(e), 0.02) for own in ("", "c", "java") if (e := [c for (_, x, _, _), c in zip(heads, cost) if own in ("", x)])}
    assert limits.mangled == pytest.approx(want) and set(limits.poor) == set(want) == set(limits.models)
    assert all(limits.models[x].total == total(x).sum() for x in want)


def test_no_head_of_a_large_table_is_left_out(spark):
    """Three heads among 40,000 are enough for the words of a tool, 25 for the limits of a language."""
    text = F.concat(F.lit("/* keeps the queue */\nint queue_"), F.col("id"), F.lit(" = read_queue(value);\nint cursor = next_record(queue, 0, value);\nreturn cursor;\n"))
    many = spark.range(40_000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 25, "ruby").otherwise("c").alias("language"), text.alias("head"), F.lit(False).alias("tool"))
    said = "/* zapfolk emitted this listing */\nint x;\n"
    few = spark.createDataFrame([(f"t{i}", "c", f"{said}int y{i};\n", True) for i in range(3)], many.schema)
    limits = handwritten.fit(many.unionByName(few))
    assert limits.speaks_of_a_tool(said, "c") and not limits.speaks_of_a_tool("/* keeps the queue */\nint x;\n", "c")
    assert set(limits.mangled) == {"", "c", "ruby"}


def test_words_of_no_tool_speak_for_none(spark):
    """A rare comment in copies is no tool's, though tools have so few comments that its lack among them says little."""
    rare = "/* " + " ".join(f"{a}{b}" for a in ("quill", "ember", "thorn", "basin", "ledge") for b in ("ward", "fold", "mere", "gate", "stone")) + " */"
    heads = [(f"r{i}", "c", f"{rare}\nint copy_{i};\n", False) for i in range(4)] + [(f"h{i}", "c", f"/* keeps the queue */\nint h{i};\n", False) for i in range(600)]
    heads += [(f"t{i}", "c", f"/* zapfolk emitted this */\nint t{i};\n", True) for i in range(10)]
    limits = handwritten.fit(spark.createDataFrame(heads, "key string, language string, head string, tool boolean"))
    assert limits.speaks_of_a_tool("/* zapfolk emitted this */", "c") and not limits.speaks_of_a_tool(rare, "c")


def test_comments_of_tools_are_learned(spark):
    """Wordings that are in no list are known from files with a tool's name; the same words elsewhere are not."""
    rng = random.Random(12)
    names = [f"{a}_{b}" for a in ("load", "store", "merge", "split") for b in ("node", "table", "entry", "sector")]
    code = lambda: "\n".join(f"int {rng.choice(names)}(int {rng.choice(names)});" for _ in range(6))
    own = lambda: f"/* {rng.choice(['checks', 'keeps', 'moves'])} the {rng.choice(names)} of a queue */"
    tool = lambda: f"/* zapfolk emitted this listing at {rng.randrange(99)} for {rng.choice(names)} */"
    heads = [(f"t{i}", "c", f"{tool()}\n{code()}", i < 60) for i in range(80)] + [(f"h{i}", "c", f"{own()}\n{code()}", False) for i in range(300)]
    limits = handwritten.fit(spark.createDataFrame(heads, "key string, language string, head string, tool boolean"))
    assert [limits.speaks_of_a_tool(h, "c") for h in (f"{tool()}\nint x;", f"{own()}\nint x;", "int x;")] == [True, False, False]
    assert handwritten.follows_template([f"field_{i}_value" for i in range(12)]) and not handwritten.follows_template(names)


def test_files_of_other_hands(spark):
    rng = random.Random(9)
    verbs, nouns = ["load", "store", "merge", "split", "probe"], ["node", "table", "entry", "volume", "sector"]
    heads = [(f"h{i}".encode(), "".join(CODE.format(rng.choice(verbs), rng.choice(nouns)) for _ in range(4))) for i in range(200)]
    special = {
        b"gen": "/* Generated by tool 1.2 from x.idl; do not edit. */\n" + heads[0][1], b"not": "/* Checks that generated nodes can be edited by hand. */\n" + heads[1][1], b"line": '#line 12 "parse.y"\n' + heads[2][1],
        b"min": "".join(f"var {a}={b}[{i}]||{c};if(!{b}){c}({a},{i});" for i, (a, b, c) in enumerate(zip("abcdefghij", "klmnopqrst", "uvwxyzabcd"))),
        b"data": "const unsigned char x[] = {\n" + "0x4a, 0xe9, 0xba, 0x79,\n" * 20, b"text": "const char y[] = {\n" + '"b1b5iE371Tv9Be97VJYDChsfgoH5lvFtaqMI2HmQh"\n' * 8, b"empty": "", b"null": None,
    }
    files = [(i, "me", "1.0", f"me-1.0/src/f{i}.c", k, None) for i, (k, _) in enumerate(heads)]
    want = {}
    cases = [
        ("src/a.c", b"gen", None, "generated"), ("src/a.c", b"not", None, None), ("src/a.c", b"line", None, "generated"), ("src/a.js", b"min", None, "minified"), ("src/a.c", b"data", None, "data"), ("src/a.c", b"text", None, "data"),
        ("src/a.c", b"empty", None, None), ("src/a.c", b"null", None, None), (None, None, None, None), (None, b"gen", None, "generated"), ("gen/a.c", None, None, "generated"), ("src/moc_x.cpp", b"h0", None, "generated"),
        ("src/x.min.js", b"h1", None, "minified"), ("src/min.js", b"h13", None, None), ("vendor/you/a.c", b"h2", None, "vendored"), ("me-1.0/node_modules/unheard/lib/a.js", b"h3", None, "vendored"), ("src/vendor_list.c", b"h4", None, None),
        ("ext/you-2.0/a.c", b"h5", None, "vendored"), ("ext/mine/a.c", b"h6", None, None), ("src/you/own.c", b"h7", None, None), ("src/you/copied.c", b"yours", None, "vendored"), ("src/a.c", b"h8", True, "vendored"), ("src/a.c", b"h9", False, None),
        ("vendor/me/a.c", b"h10", None, None), ("vendor/a.c", b"h11", None, None),
    ]
    for i, (path, key, mark, kind) in enumerate(cases, 1000):
        files.append((i, "me", "1.0", path, key, mark))
        want[i] = kind
    files += [(2000, "you", "2.0", "you-2.0/src/copied.c", b"yours", None), (2001, None, "1.0", "you-1.0/src/z.c", b"h12", None), (2002, None, None, None, None, None)]
    files += [(2003, "me", "1.1", None, b"h2", None), (2004, "you", "2.0", None, b"h2", None), (2005, "me", "1.1", "src/plain.c", b"h0", None)]
    want |= {2000: None, 2001: None, 2002: None, 2003: "vendored", 2004: None, 2005: "generated"}
    f = spark.createDataFrame(files, "row_id long, package string, version string, pathname string, key binary, thirdparty boolean").withColumn("filename", F.regexp_extract("pathname", "[^/]*$", 0)).withColumn("kind", F.lit("clash")).withColumn("head", F.lit(1))
    h = spark.createDataFrame([*heads, *special.items(), (None, "x"), (b"yours", heads[3][1])], "key binary, head string").withColumn("language", F.lit("clash"))
    got = {r.row_id: r.kind for r in not_handwritten(f, h).collect()}
    assert {i: got.get(i) for i in want} == want
    # h0 and h1 bear a tool's name elsewhere.
    assert {i for i in got if i < 1000} == {0, 1}


def test_files_of_empty_tables(spark):
    f = spark.createDataFrame([], "row_id long, package string, version string, pathname string, key binary, thirdparty boolean").withColumn("filename", F.regexp_extract("pathname", "[^/]*$", 0))
    h = spark.createDataFrame([], "key binary, head string")
    assert not_handwritten(f, h).count() == 0
    one = spark.createDataFrame([(1, "p", "1", "gen/a.c", b"k", None, "a.c")], f.schema)
    assert [r.kind for r in not_handwritten(one, h).collect()] == ["generated"]
    assert handwritten.LANGUAGES["py"] == "python"
