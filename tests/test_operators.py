"""Small cases of the other operators, with the results they must have."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import attribute, audit, clones, files, graph, match, report
from strandline.operators import knowledge as K


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


@pytest.fixture(scope="module")
def cache(spark):
    return spark.createDataFrame(
        [("C", "only here", "p", "a.c"), ("C", "same file", "p", "a.c"), ("C", "same file", "q", "a.c"), ("C", "not clone", "p", "a.c"), ("C", "not clone", "q", "b.c"), *[("C", "common", f"k{i}", f"f{i}.c") for i in range(40)]],
        "language string, line string, package string, filename string",
    )


@pytest.fixture(scope="module")
def classified(spark, cache):
    lines = [("x", "C", line) for line in ("only here", "only here", "same file", "not clone", "common", "nowhere", "abc", "", None)]
    return match.classify(match.lines_of(spark.createDataFrame(lines, "container string, language string, line string")), cache)


def test_classes_and_conservation(classified):
    got = dict(rows(classified, "line", "class"))
    assert got == {"only here": "unique", "same file": "cloned", "not clone": "notclone", "common": "nonassigned", "nowhere": "unmatched", "abc": "ignored"}
    c = match.counters(classified).collect()[0]
    assert c.lines == 7 == c.ignored + c.unmatched + c.unique + c.nonassigned + c.notclone + c.cloned


def test_scores_and_cover(spark, cache, classified):
    scores = match.package_scores(classified, cache)
    assert rows(scores) == [("x", "p", 9.0, 9 / 5), ("x", "q", 0.0, 9 / 5)]
    averages = spark.createDataFrame([("C", "p", 3.0), ("C", "q", 9.0)], "language string, package string, avgstrings double")
    assert rows(match.greedy_cover(classified, cache, scores, averages)) == [("x", "p", 9.0)]
    none = scores.withColumn("unique_score", F.lit(0.0))
    # Without any unique score the package of least average wins.
    assert rows(match.greedy_cover(classified, cache, none, averages)) == [("x", "p", 9.0)]
    flipped = averages.withColumn("avgstrings", 10 - F.col("avgstrings"))
    assert rows(match.greedy_cover(classified, cache, none, flipped)) == [("x", "q", 9.0)]


def test_rank_shares(spark):
    got = match.rank(spark.createDataFrame([("x", "b", 1.0), ("x", "a", 1.0), ("x", "c", 2.0), ("y", "z", 0.0)], "container string, package string, score double"))
    assert rows(got, "container", "package", "share", "rank") == [("x", "a", 25.0, 2), ("x", "b", 25.0, 3), ("x", "c", 50.0, 1), ("y", "z", 0.0, 1)]


def test_source_order(spark, cache):
    ids = spark.createDataFrame([("x", "C", 1, "same file"), ("x", "C", 2, "only here"), ("x", "C", 3, "same file"), ("x", "C", 4, "not clone"), ("x", "C", 5, "nowhere")], "container string, language string, ordinal long, line string")
    assert rows(match.source_order(ids, cache), "ordinal", "package") == [(3, "p"), (4, "p")]


IDS, HELD = "container string, language string, ordinal long, line string", "language string, line string, package string, filename string"


def test_backward_run_ends_at_the_first_miss(spark):
    held = [("C", "first p", "p", "a.c"), ("C", "then p", "p", "b.c"), ("C", "miss!", "p", "d.c"), ("C", "miss!", "q", "d.c"), *[("C", x, k, "b.c") for x in ("share1", "share2", "share3") for k in "pq"]]
    lines = ["share1", "first p", "share1", "miss!", "share2", "nowhere", "share3", "then p", "share1"]
    ids = spark.createDataFrame([("x", "C", i, line) for i, line in enumerate(lines)], IDS)
    kb = spark.createDataFrame(held, HELD)
    assert rows(match.direct_matches(ids, kb), "ordinal", "package", "way") == [(4, "p", "backward"), (6, "p", "backward"), (8, "p", "forward")]
    # 7 + 6 of unique lines; 3 lines of 6 directly; of the rest (two of share1, one miss!) all go to p, which alone has a unique score.
    averages = spark.createDataFrame([("C", "p", 3.0), ("C", "q", 9.0)], "language string, package string, avgstrings double")
    assert rows(match.source_order_scores(ids, kb, averages), "package", "unique_score", "nonunique_score", "direct_score", "same_file_score") == [("p", 13.0, 0.0, 18.0, 17.0)]


def _in_order(lines, kb):
    """Places and scores (but for the greedy cover), line by line."""
    last, files, log, open_, placed, score = None, set(), [], [], [], {}

    def add(package, k, x):
        score.setdefault(package, [0.0] * 3)[k] += x

    for i, line in enumerate(lines):
        here = kb.get(line, {})
        if len(here) == 1:
            (last,), (files,) = here, here.values()
            add(last, 0, len(line))
            for j, old, old_files, value in reversed(log):
                if not files & old_files:
                    break
                placed.append((j, last, "backward"))
                add(last, 2, value)
                for q in open_:
                    if q[0] == j:
                        for owner in q[1]:
                            add(owner, 1, -value)
            log, open_ = [], []
        elif here:
            names = [f for fs in here.values() for f in fs]
            value = len(line) / 5.0 ** (len(set(names)) - 1)
            if files & here.get(last, set()):
                placed.append((i, last, "forward"))
                add(last, 2, value)
                continue
            if last in here:
                log.append((i, line, here[last], value))
            if len(names) == len(set(names)):
                owners = [p for p, fs in here.items() for _ in fs]
                open_.append((i, owners))
                for owner in owners:
                    add(owner, 1, value)
    return sorted(placed), score


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_source_order_line_by_line(spark, seed):
    import random

    r = random.Random(seed)
    kb = {f"line {k:02}": {p: set(r.sample("abcd", r.randint(1, 2))) for p in r.sample("pqr", r.choice([1, 2, 2, 3]))} for k in range(30)}
    held = spark.createDataFrame([("C", line, p, f) for line, own in kb.items() for p, fs in own.items() for f in fs], HELD)
    lines = {c: [f"line {r.randrange(34):02}" for _ in range(150)] for c in "xy"}
    ids = spark.createDataFrame([(c, "C", i, line) for c, own in lines.items() for i, line in enumerate(own)], IDS)
    got, averages = match.direct_matches(ids, held), spark.createDataFrame([], "language string, package string, avgstrings double")
    scores = match.source_order_scores(ids, held, averages).collect()
    for c, own in lines.items():
        placed, score = _in_order(own, kb)
        assert rows(got.where(F.col("container") == c), "ordinal", "package", "way") == placed and {"backward", "forward"} == {w for *_, w in placed}
        for s in (s for s in scores if s.container == c):
            assert [s.unique_score, s.nonunique_score, s.direct_score] == pytest.approx(score.get(s.package, [0.0] * 3))


@pytest.fixture(scope="module")
def in_tables(spark):
    """The same lines as tables and as texts: (Numbered, identifiers, cache, strings, files)."""
    import random

    r = random.Random(5)
    strings = [(f"k{r.randrange(12)}", r.choice("CCJ"), f"line {r.randrange(30):02}", i) for i in range(400)] + [("k0", "C", "", 900), ("k0", None, "line 01", 901), (None, "C", "line 01", 902), ("k1", "C", None, 903), ("k1", "C", "abc", 904)]
    files = [(f"k{k}", r.choice("pqr"), f"{r.randrange(3)}", r.choice(["a.c", "b.c", "c.c"])) for k in range(12) for _ in range(1 + k % 2)] + [("k3", None, "1", "a.c"), ("k4", "q", None, None), (None, "p", "1", "a.c")]
    files += [(f"u{i}", r.choice("pqr"), "1", r.choice(["a.c", "b.c", "c.c"])) for i in range(60)]
    strings += [(f"u{i}", "C", f"line {r.randrange(30):02}", 1000 + i) for i in range(20)] + [(f"u{i}", "C", f"only {i:02}", 2000 + i) for i in range(20, 60)]
    contents = [(f"x{r.randrange(5)}", f"k{r.randrange(13)}") for _ in range(30)] + [(f"x{i % 5}", f"u{i}") for i in range(60)] + [(None, "k0"), ("x0", None)]
    r.shuffle(strings)
    strings = spark.createDataFrame([(*x[:3], i) for i, x in enumerate(strings)], "key string, language string, line string, ordinal long")
    files, contents = spark.createDataFrame(files, "key string, package string, version string, filename string"), spark.createDataFrame(contents, "container string, key string")
    ids = strings.join(contents.dropna().distinct(), "key").select("container", "language", "line", "ordinal").where("line is not null and language is not null")
    return lambda cutoff: match.numbered_tables(strings, files, contents, cutoff=cutoff), ids, K.identifier_cache(strings, files), strings, files


def test_direct_matches_of_tables(in_tables):
    of, ids, kb, *_ = in_tables
    got = rows(match.direct_matches_of(of(5)), "container", "language", "ordinal", "line", "package", "way")
    assert got == rows(match.direct_matches(ids, kb), "container", "language", "ordinal", "line", "package", "way") and {"forward", "backward"} == {x[-1] for x in got}


def test_source_order_of_tables(in_tables):
    of, ids, kb, *_ = in_tables
    got = rows(match.source_order_of(of(0)), "container", "language", "ordinal", "line", "package")
    assert got == rows(match.source_order(ids, kb), "container", "language", "ordinal", "line", "package") and len(got) > 20


def test_source_order_scores_of_tables(in_tables):
    of, ids, kb, strings, files = in_tables
    columns = ["container", "package", "unique_score", "nonunique_score", "direct_score", "same_file_score"]
    n = of(5)
    got = rows(match.source_order_scores_of(n, K.average_strings(n.strings, n.files)), *columns)
    want = rows(match.source_order_scores(ids, kb, K.average_strings(strings, files)), *columns)
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(got) > 5
    assert [v for x in got for v in x[2:]] == pytest.approx([v for x in want for v in x[2:]])


def test_score_of_many_files(spark):
    many = spark.createDataFrame([("C", "abcde", f"p{i}", f"f{i}") for i in range(60)] + [("C", "xyz", "p", f"f{i}") for i in range(3)], "language string, line string, package string, filename string")
    assert rows(K.score_table(K.line_facts(many)), "line", "packages", "score") == [("abcde", 60, 0.0), ("xyz", 1, 3.0)]


def test_first_rename_holds(spark):
    renames = spark.createDataFrame([(2, "a", "late"), (1, "a", "b"), (3, "c", None)], "row_id long, originalname string, newname string")
    assert rows(K.aliased(spark.createDataFrame([("a",), ("c",), (None,), ("z",)], "package string").fillna("-"), renames)) == [("-",), ("b",), ("c",), ("z",)]


def test_kernel_variants(spark):
    df = spark.createDataFrame([("<6>usb: plugged",), ("7days",), ("exact",), ("none: at all",)], "m string")
    known = spark.createDataFrame([("plugged",), ("days",), ("exact",)], "f string")
    assert rows(match.first_variant(df, ["m"], match.kernel_variants(F.col("m")), known, "f")) == [("7days", 3, "days"), ("<6>usb: plugged", 2, "plugged"), ("exact", 0, "exact")]


def test_prune_keeps_maximal_versions(spark):
    lines = {"1": "ab", "2": "abc", "3": "abc", "4": "d"}
    df = spark.createDataFrame([("x", "p", line, v) for v, own in lines.items() for line in own], "container string, package string, line string, version string")
    assert rows(attribute.prune_versions(df), "version") == [("2",), ("3",), ("4",)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matched_versions_are_the_pruned_ones(spark, seed):
    """Against sets; more versions than a word has bits, one line in two languages, files of no package or no name."""
    import random

    r = random.Random(seed)
    strings = {(f"k{r.randrange(40)}", r.choice("CJ"), f"line {r.randrange(25)}") for _ in range(120)} | {("k0", "C", "tiny"), ("k0", None, "of no language")}
    held = {(f"k{r.randrange(36)}", "p" if r.random() < 0.9 else "q", f"{r.randrange(90)}", r.choice(["a.c", "b.c", None])) for _ in range(500)} | {("k1", None, "1", "a.c"), (None, "p", "1", "a.c")}
    inside = {(f"x{r.randrange(12)}", f"k{r.randrange(40)}") for _ in range(60)} | {(None, "k0"), ("x0", None)}
    owners, lines = {}, {}
    for k, language, line in strings:
        owners.setdefault((language, line), set()).update(p for key, p, _, name in held if key == k and p and name)
    for c, k in inside:
        for key, language, line in strings:
            if c and key == k and language and len(line) >= 5 and len(own := owners[language, line]) == 1:
                of = {v for k2, *same in strings if same == [language, line] for k3, p, v, _ in held if k3 == k2 and p in own}
                for v in of:
                    lines.setdefault((c, *own), {}).setdefault(v, set()).add(line)
    kept = sorted((*key, v) for key, sets in lines.items() for v, own in sets.items() if not any(own < other for other in sets.values()))
    df = lambda data, schema: spark.createDataFrame(sorted(data, key=str), schema)
    strings, files, contents = df(strings, "key string, language string, line string"), df(held, "key string, package string, version string, filename string"), df(inside, "container string, key string")
    assert rows(attribute.matched_versions(strings, files, contents, cutoff=5)) == kept and len(kept) > 20


def test_squash_and_agreement(spark):
    df = spark.createDataFrame([(1, "n", "GPLv2"), (1, "f", "GPL_v2"), (2, "n", "MIT"), (3, "f", "BSD")], "key int, scanner string, verdict string")
    assert rows(attribute.squash(df, {"GPLv2": "GPL_v2", "MIT": "MIT style"}, "n", "f")) == [(1, "squashed", "GPL_v2"), (2, "n", "MIT"), (3, "f", "BSD")]
    assert attribute.agreement(df, "n", "f").count() == 3


def test_ranges(spark):
    r = spark.createDataFrame([("f", 10, 20), ("f", 15, 40), ("f", 50, 60), ("f", 5, 5)], "key string, lo long, hi long")
    p = spark.createDataFrame([("f", x) for x in (9, 10, 39, 40, 45, 59, 60)], "key string, x long")
    assert rows(files.inside_ranges(p, r, width=7)) == [("f", 9, None), ("f", 10, 20), ("f", 39, 40), ("f", 40, None), ("f", 45, None), ("f", 59, 60), ("f", 60, None)]
    assert rows(files.next_range(p, r)) == [("f", 9, 10), ("f", 10, 15), ("f", 39, 50), ("f", 40, 50), ("f", 45, 50), ("f", 59, 0), ("f", 60, 0)]
    assert rows(files.gaps(r.where("hi > lo"))) == [("f", 40, 50)]


def test_duplicates_and_gates(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), (None, "c"), (None, "d")], "key string, path string")
    assert rows(files.first_of_each(df, "key", [F.col("path")]), "path", "duplicate") == [("a", False), ("b", True), ("c", False), ("d", False)]
    t = spark.createDataFrame([(["elf"],), (["text"],), (["elf", "x"],), (None,)], "tags array<string>")
    assert t.where(files.gate(F.col("tags"), ["elf"], ["x"])).count() == 1
    offsets = spark.createDataFrame([("k", "tar1", 257), ("k", "gzip", 3)], "key string, marker string, offset long")
    got = files.markers_first(spark.createDataFrame([("k",)], "key string"), offsets, {"tar1": 257}, ["tar1", "gzip"])
    assert rows(got, "place", "marker") == [(1, "tar1"), (2, "gzip")]


def test_containment(spark):
    sets = {"a": "12", "b": "123", "c": "12", "d": "9"}
    df = spark.createDataFrame([(p, k) for p, own in sets.items() for k in own], "package string, key string")
    assert rows(clones.contained(df)) == [("a", "b", 2, 3, "partial"), ("a", "c", 2, 2, "identical"), ("c", "a", 2, 2, "identical"), ("c", "b", 2, 3, "partial")]


def test_append_and_replace(spark, tmp_path):
    from strandline.sources import sinks

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        sinks.append_new(df, f"{tmp_path}/t", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    assert rows(clones.replaced(df, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"])) == [(1, "z"), (2, "c")]
    sinks.append_facts(df, f"{tmp_path}/p", ["k"])
    sinks.replace_partitions(spark.createDataFrame([("n", 1)], "v string, k int"), f"{tmp_path}/p", ["k"])
    assert rows(spark.read.parquet(f"{tmp_path}/p").select("k", "v")) == [(1, "n"), (2, "c")]
    sinks.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 3
    sinks.write_reports(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    conversion = spark.createDataFrame([("s", "m")], "sha256 string, md5 string")
    assert rows(sinks.with_hashes(spark.createDataFrame([("s",), ("t",)], "checksum string"), conversion, "md5")) == [("m",), ("t",)]


def test_licences_and_copyrights_of_files(spark):
    own = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "key string")
    licences = spark.createDataFrame([("1", "MIT", "a"), ("1", "MIT", "a"), ("1", "MIT", "b"), ("2", None, "a"), ("3", "BSD", "a"), (None, "BSD", "a")], "key string, licence string, scanner string")
    assert rows(attribute.licences_of(own, licences)) == [("1", "MIT", "a"), ("1", "MIT", "b")]
    held = [("1", "(c) x", "statement"), ("1", "x@y", "email"), ("2", "x@y", "email"), ("2", "x@y", "email"), ("2", "z", None), ("3", "u", "url")]
    got = rows(attribute.copyrights_of(own, spark.createDataFrame(held, "key string, copyright string, type string")).fillna("-"))
    assert got == [("1", "x@y", "email"), ("2", "x@y", "email"), ("2", "z", "-")]


def test_types_are_narrowed_by_version(spark):
    symbols = spark.createDataFrame([("1", "s", "gpl"), ("2", "s", "free"), ("3", "s", "gpl"), ("3", "s", "free"), ("4", "one", "gpl"), ("9", "s", "free"), ("5", "none", None)], "key string, symbol string, type string")
    files = spark.createDataFrame([("1", "p", "2.6"), ("2", "p", "2.6-x"), ("3", "p", "2.6-y"), ("4", "q", "1"), ("9", "q", "7")], "key string, package string, version string")
    wanted = [("2.6", "s"), ("2.6-x", "s"), ("2.6-y", "s"), ("2.6-z-1", "s"), ("7", "s"), ("7-1", "s"), ("5", "one"), ("5", "none"), ("5", "other")]
    got = graph.narrowed_types(spark.createDataFrame([("p", v, s) for v, s in wanted], "package string, version string, symbol string"), symbols, files)
    # 7 is a version of another package only; 2.6-y has both types, so 2.6 is not asked.
    assert {(r.version, r.symbol): r.type for r in got.collect()} == dict(zip(wanted, ["gpl", "free", "undecided", "gpl", "undecided", "undecided", "gpl", "unknown", "unknown"]))


def test_closure_of_a_circle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "src string, dst string")
    got = {(s, d): n for s, d, n in rows(graph.closure(edges))}
    assert len(got) == 12 and got["a", "d"] == 3 and got["a", "a"] == 3
    links = spark.createDataFrame([("l", "m"), ("m", "n"), ("n", "file"), ("o", "p"), ("p", "o")], "path string, target string")
    assert rows(graph.resolved_links(links)) == [("l", "file"), ("m", "file"), ("n", "file")]


def test_long_chains_are_whole(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(66)]
    got = graph.closure(spark.createDataFrame(chain, "src string, dst string")).where("src = 'n0'")
    assert got.agg(F.max("depth"), F.count(F.lit(1))).first()[:] == (66, 66)
    with pytest.raises(ValueError, match="above 2"):
        graph.closure(spark.createDataFrame(chain[:3], "src string, dst string"), most=2)
    assert graph.closure(spark.createDataFrame(chain[:2], "src string, dst string"), most=2).count() == 3
    links = graph.resolved_links(spark.createDataFrame([*chain, ("o", "p"), ("p", "o"), ("q", "o")], "path string, target string"))
    assert rows(links) == sorted((f"n{i}", "n66") for i in range(66))


def test_symbol_passes(spark):
    undefined = spark.createDataFrame([("f", "s", "func", False), ("f", "w", "func", True), ("f", "none", "func", False)], "file string, symbol string, kind string, weak boolean")
    defined = spark.createDataFrame([("l1", "s", "func", True), ("l2", "s", "func", False), ("l1", "w", "func", True), ("l3", "s", "func", False)], "library string, symbol string, kind string, weak boolean")
    declared = spark.createDataFrame([("f", "l1"), ("f", "l2"), ("f", "l4")], "file string, library string")
    found = graph.resolved_symbols(undefined, defined, declared)
    assert rows(found, "symbol", "library", "pass") == [("s", "l2", 1), ("w", "l1", 4)]
    assert rows(graph.library_use(declared, found), "library", "symbols", "used") == [("l1", 1, True), ("l2", 1, True), ("l4", 0, False)]


def test_licence_conflicts_and_types(spark):
    edges = spark.createDataFrame([("m", "k", "gplkernelsymbol"), ("g", "k", "gplkernelsymbol"), ("m", "k", "kernelsymbol")], "src string, dst string, type string")
    licences = spark.createDataFrame([("m", "Proprietary"), ("g", "GPL v2")], "file string, licence string")
    assert rows(graph.licence_conflicts(edges, licences)) == [("m", "k", "gplkernelsymbol")]
    modules = spark.createDataFrame([("m", "1"), ("n", "2")], "module string, version string")
    assert rows(graph.other_versions(modules, spark.createDataFrame([("1",)], "version string"))) == [("n", "2")]


def test_report_tables(spark):
    ranked = spark.createDataFrame([("x", "a", 70.0, 1), ("x", "b", 29.0, 2), ("x", "c", 1.0, 3)], "container string, package string, share double, rank int")
    assert rows(report.with_others(ranked, upto=90, least=2)) == [("x", "a", 70.0), ("x", "b", 29.0), ("x", "others", 1.0)]
    v = spark.createDataFrame([("p", "2.6.18"), ("p", "2.6.19"), ("p", "3.0"), ("p", "x")], "package string, version string")
    assert rows(report.squashed_versions(v, ["package"]), "versions") == [("2.6.{18, 19}",), ("3.0",), ("x",)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(X.common_prefix(lit("abc"), lit("abd"))) == 2 and one(X.common_prefix(lit("ab"), lit("ab"))) == 2 and one(X.common_prefix(lit("ab"), lit("abc"))) == 2
    assert one(X.version_key(lit("1.10.2-rc1"))) == [1, 10, 2]
    assert one(X.unescaped(lit('a\\"b\\tc\\\\d'))) == 'a"b\tc\\d'
    assert one(X.line_at(lit("a\nb\nc"), lit(4))) == 2
    assert one(X.pieces(lit("ab\x00c\x1bd"))) == ["ab", "c", "d"]
    assert one(X.runs(lit("\x01hello\x02hi\x03worlds"))) == ["hello", "worlds"]
    assert one(X.printable(lit("a\tb"))) and not one(X.printable(lit("é")))
    assert tuple(one(X.cpe_parts(lit("cpe:/a:v:p:1.2")))) == ("v", "p", "1.2")
    assert tuple(one(X.archive_parts(lit("foo-bar-1.2rc1.tar.gz")))) == ("foo-bar", "1.2rc1")
    assert one(files.without_root(lit("p-1.0+dfsg/src/a.c"), lit("p"), lit("1.0+dfsg"))) == "src/a.c"
    assert one(files.ancestors(lit("a/b/c"))) == ["a/", "a/b/", "a/b/c"]
    assert one(X.language_of(lit("x/y.py"))) == "Python" and one(X.language_of(lit("x/Makefile"))) is None
    assert one(X.language_of_tags(F.array(lit("dalvik")))) == "Java"


def test_audits(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(audit.emails(lit("a@b.org, x@example.com, .c@d.org a..b@c.org a@b.org"))) == ["a@b.org"]
    assert one(audit.urls(lit("http://a.org/x http://10.0.0.1/ https://host/ http://127.0.0.1"))) == ["http://a.org/x"]
    assert one(audit.shell_invocation(lit("/sbin/ifconfig %s"))) and not one(audit.shell_invocation(lit("/sbin/ifconfig")))
    assert one(audit.copyright_line(lit("Copyright 2020"))) and one(audit.copyright_line(lit("(C) me")))
    df = spark.createDataFrame([(1, "x = gets(buf);\nsystem (cmd); gets(a)"), (2, None), (3, "")], "k int, t string")
    assert rows(audit.calls(df, ["k"], "t", ("gets", "system"))) == [(1, "gets", 1), (1, "gets", 2), (1, "system", 2)]
    words = spark.createDataFrame([("buf",), ("cm",), ("",), ("zz",), (None,), ("cm",)], "word string")
    assert rows(audit.containing(df, "k", "t", words)) == [(1, "buf"), (1, "cm")] == rows(audit.containing(df, "k", "t", words, most=1))
    assert audit.containing(df, "k", "t", words.limit(0)).count() == 0
    assert rows(audit.marked(df, ["k"], "t", {"m": ("gets", "puts"), "n": ("nothing",)})) == [(1, "m")]
    entries = spark.createDataFrame([("e", 5), ("z", 0)], "entry string, crc long")
    assert rows(audit.crc_matches(entries, spark.createDataFrame([(5, "k"), (0, "n")], "crc long, key string"))) == [(5, "e", "k")]
    shadow = spark.createDataFrame([("root", "h"), ("x", None)], "login string, hash string")
    assert rows(audit.log_in_hits(shadow, spark.createDataFrame([("h", "pw")], "hash string, password string"))) == [("root", "h", "pw")]


def test_paths_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(X.normal_path(lit("/usr//lib/./x/../y"))) == "/usr/lib/y" and one(X.normal_path(lit("a/../../b"))) == "b"
    assert one(X.bare_function(lit("ns::Type::run(int, std::x)"))) == "run" and one(X.bare_function(lit("main"))) == "main"
    assert one(X.macro_arguments(lit('EXPORT_SYMBOL(a); MODULE_LICENSE("GPL"); EXPORT_SYMBOL_GPL( b )'), ["EXPORT_SYMBOL", "EXPORT_SYMBOL_GPL"])) == ["a", "b"]
    assert one(X.spec_sources(lit("Name: x\nSource0: a.tgz\nPatch1:  b.patch\n"))) == ["a.tgz", "b.patch"]


def test_trailers_and_statistics(spark):
    at = lambda *xs: spark.createDataFrame([("f", x) for x in xs], "key string, offset long")
    assert rows(files.next_trailer(at(1, 5, 9), at(3, 5))) == [("f", 1, 3), ("f", 5, 5)]
    df = spark.createDataFrame([(["a", "b"], 2), (["a"], 3), ([], 1)], "tags array<string>, size long")
    assert rows(files.tag_statistics(df)) == [("a", 2, 5), ("b", 1, 2)]


def test_plugins_and_edges(spark):
    pair = lambda xs: spark.createDataFrame(xs, "file string, symbol string")
    plugins = spark.createDataFrame([("p",)], "file string")
    got = graph.plugin_uses(plugins, pair([("p", "s"), ("p", "t"), ("h", "s")]), pair([("h", "s"), ("h", "t"), ("p", "s")]))
    assert rows(got) == [("p", "h", 2)]
    edges = spark.createDataFrame([("a", "b", "k"), ("a", "b", "k"), ("a", "b", "g")], "src string, dst string, type string")
    assert rows(graph.edge_counts(edges)) == [("a", "b", "g", 1), ("a", "b", "k", 2)]
