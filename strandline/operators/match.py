"""Matching the strings of unknown binaries with the knowledge base, classification, scoring and ranking."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.knowledge import ALPHA, identifier_cache, line_facts
from strandline.session import cut, drop

CUTOFF, SCORE_CUTOFF, GAIN_CUTOFF = 5, 1e-20, 1.0


def lines_of(identifiers: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """(container, language, line, n, ignored) from (container, language, line): each line once with its multiplicity.

    Lines shorter than ``cutoff`` are marked as ignored; null and empty lines are left out."""
    own = identifiers.where("line is not null and line != '' and language is not null")
    return own.groupBy("container", "language", "line").agg(F.count(F.lit(1)).alias("n")).withColumn("ignored", F.length("line") < cutoff)


def classify(lines: DataFrame, cache: DataFrame) -> DataFrame:
    """``lines`` with class and score: ignored, unmatched, unique, nonassigned, notclone or cloned.

    A line of one package is unique; one whose penalised score is used up is not assigned; one whose every file name
    belongs to a single package is no clone; all others are cloned."""
    return _classed(lines.join(line_facts(cache), ["language", "line"], "left"), F.length("line"))


def _classed(out: DataFrame, length: Column) -> DataFrame:
    shared = length / F.pow(F.lit(ALPHA), F.col("n_filenames") - 1)
    kind = (
        F.when(F.col("ignored"), "ignored")
        .when(F.col("n_packages").isNull(), "unmatched")
        .when(F.col("n_packages") == 1, "unique")
        .when(shared <= SCORE_CUTOFF, "nonassigned")
        .when(F.col("n_pairs") == F.col("n_filenames"), "notclone")
        .otherwise("cloned")
    )
    score = F.when(F.col("class") == "unique", length.cast("double")).when(F.col("class").isin("notclone", "cloned"), shared)
    return out.withColumn("class", kind).withColumn("score", score)


def counters(classified: DataFrame) -> DataFrame:
    """Per container: lines of each class, with multiplicity."""
    n = lambda c: F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(c)
    return classified.groupBy("container").agg(F.sum("n").alias("lines"), *[n(c) for c in ("ignored", "unmatched", "unique", "nonassigned", "notclone", "cloned")])


def package_scores(classified: DataFrame, cache: DataFrame) -> DataFrame:
    """(container, package, unique_score, nonunique_score): the parts of the score that need no assignment."""
    unique = classified.where("class = 'unique'").select("container", "package", F.col("score").alias("u"), F.lit(0.0).alias("o"))
    shared = classified.where("class = 'notclone'").select("container", "language", "line", "score")
    other = shared.join(cache, ["language", "line"]).select("container", "package", F.lit(0.0).alias("u"), F.col("score").alias("o"))
    return unique.unionByName(other).groupBy("container", "package").agg(F.sum("u").alias("unique_score"), F.sum("o").alias("nonunique_score"))


def greedy_cover(classified: DataFrame, cache: DataFrame, scores: DataFrame, averages: DataFrame, *, gain: float = GAIN_CUTOFF, gone: DataFrame | None = None) -> DataFrame:
    """(container, package, same_file_score): cloned lines assigned to packages in greedy rounds.

    A line goes, for each of its file names, to one of the packages that hold it under this name; only those with the
    greatest unique score stay candidates. In each round the package of the greatest gain gets all its open lines;
    among packages within a tenth of it the one with most average strings wins when there is any unique score, else
    the one with least. Rounds end when the gain falls below ``gain``. Ties go to the lesser name. Only cloned lines
    reach Python; they are few per container, as lines of many file names have no score left. ``gone`` has
    (container, language, line, filename) that take no part.
    """
    cloned = classified.where("class = 'cloned'").select("container", "language", "line", "n", "score")
    rows = cloned.join(cache, ["language", "line"])
    rows = rows if gone is None else rows.join(gone, ["container", "language", "line", "filename"], "left_anti")
    rows = rows.join(scores.select("container", "package", "unique_score"), ["container", "package"], "left").join(averages, ["language", "package"], "left")
    rows = rows.select("container", "language", "line", "filename", "package", "n", "score", F.coalesce("unique_score", F.lit(0.0)).alias("u"), F.coalesce("avgstrings", F.lit(0.0)).alias("avg"))

    def cover(frame: pd.DataFrame) -> pd.DataFrame:
        entry = frame.groupby(["language", "line", "filename"], sort=False).ngroup().to_numpy()
        names, package = np.unique(frame["package"].to_numpy(object), return_inverse=True)
        score, n, u = (frame[c].to_numpy(float) for c in ("score", "n", "u"))
        average = np.zeros(len(names))
        np.maximum.at(average, package, frame["avg"].to_numpy(float))
        best = np.zeros(entry.max() + 1)
        np.maximum.at(best, entry, u)
        own, any_unique, out = u == best[entry], bool((u > 0).any()), {}
        while own.any():
            gains = np.bincount(package[own], score[own], len(names))
            if gains.max() < gain:
                break
            close = np.flatnonzero(gains > 0.9 * gains.max())
            winner = min(close, key=lambda p: (-average[p] if any_unique else average[p], p))
            taken = own & (package == winner)
            out[names[winner]] = out.get(names[winner], 0.0) + float((score[taken] * n[taken]).sum())
            gone = np.zeros(len(best), bool)
            gone[entry[taken]] = True
            own &= ~gone[entry]
        container = frame["container"].iloc[0]
        return pd.DataFrame({"container": [container] * len(out), "package": list(out), "same_file_score": list(out.values())}).astype({"container": object, "package": object})

    return rows.groupBy("container").applyInPandas(cover, f"container {rows.schema['container'].dataType.simpleString()}, package string, same_file_score double")


def rank(scores: DataFrame) -> DataFrame:
    """(container, package, score, share, rank) from rows with container, package and score; ties by name."""
    by = Window.partitionBy("container")
    total = F.sum("score").over(by)
    share = F.when(total > 0, F.col("score") / total * 100).otherwise(F.lit(0.0))
    return scores.select("container", "package", "score", share.alias("share"), F.row_number().over(by.orderBy(F.desc("score"), "package")).alias("rank"))


class Numbered(NamedTuple):
    """The knowledge base and the lines of containers with numbers in place of texts.

    lines has id, language and line (the text), cache language, line (the id), package and filename, facts id, length, n_packages,
    n_filenames, n_pairs, package and only (the package of a unique line), own the known lines in containers:
    container, language, ordinal, id, unique. strings has key, language, line (the id) and ordinal, files key, package, version and
    filename; names has container and name, or is None where containers have their own names."""

    lines: DataFrame
    cache: DataFrame
    facts: DataFrame
    own: DataFrame
    strings: DataFrame | None = None
    files: DataFrame | None = None
    names: DataFrame | None = None


def _facts(cache: DataFrame, lines: DataFrame) -> DataFrame:
    facts = line_facts(cache).select(F.col("line").alias("id"), "n_pairs", "n_packages", "package", "n_filenames")
    return cut(facts.join(lines.select("id", F.length("line").alias("length")), "id").withColumn("only", F.when(F.col("n_packages") == 1, F.col("package"))))


def _known(facts: DataFrame, cutoff: int) -> DataFrame:
    return facts.where(F.col("length") >= cutoff).select("id", F.col("only").isNotNull().alias("unique"))


def numbered(identifiers: DataFrame, cache: DataFrame, *, cutoff: int = 0) -> Numbered:
    """From (container, language, ordinal, line) and a cache; lines shorter than ``cutoff`` and unknown ones take no part."""
    lines = cut(cache.select("language", "line").distinct().withColumn("id", F.monotonically_increasing_id()))
    cache = cut(cache.join(lines, ["language", "line"]).select("language", F.col("id").alias("line"), "package", "filename"))
    facts = _facts(cache, lines)
    own = identifiers.join(lines, ["language", "line"]).join(_known(facts, cutoff), "id").select("container", "language", "ordinal", "id", "unique")
    return Numbered(lines, cache, facts, own)


def numbered_tables(strings: DataFrame, files: DataFrame, contents: DataFrame, *, cutoff: int = 0) -> Numbered:
    """From strings (key, language, line, ordinal), files (key, package, version, filename) and contents (container, key).

    Lines get their numbers and facts once for each string of a file, before the files meet the containers that hold them."""
    inside = contents.select("container", "key").dropna().distinct()
    keys = cut(files.select("key").dropna().union(inside.select("key")).distinct().withColumn("file", F.monotonically_increasing_id()))
    names = cut(inside.select(F.col("container").alias("name")).distinct().withColumn("container", F.monotonically_increasing_id()))
    inside = cut(inside.withColumnRenamed("container", "name").join(keys, "key").join(names, "name").select("container", F.col("file").alias("key")))
    filenames = cut(files.select("filename").dropna().distinct().withColumn("number", F.monotonically_increasing_id()))
    held = cut(files.join(keys, "key").join(filenames, "filename", "left").select(F.col("file").alias("key"), "package", "version", F.col("number").alias("filename")))
    texts = cut(strings.dropna(subset=["key", "language", "line"]).join(keys, "key").select("file", "language", "line", "ordinal"))
    drop(keys, filenames)
    lines = cut(texts.select("language", "line").distinct().withColumn("id", F.monotonically_increasing_id()))
    rows = cut(texts.join(lines, ["language", "line"]).select(F.col("file").alias("key"), "language", F.col("id").alias("line"), "ordinal"))
    drop(texts)
    cache = cut(identifier_cache(rows, held))
    facts = _facts(cache, lines)
    known = cut(rows.withColumnRenamed("line", "id").join(_known(facts, cutoff), "id").select("key", "language", "ordinal", "id", "unique"))
    own = known.join(inside, "key").select("container", "language", "ordinal", "id", "unique")
    return Numbered(lines, cache, facts, own, rows, held, names)


def _named(n: Numbered, df: DataFrame) -> DataFrame:
    """``df`` with the names of its containers."""
    return df if n.names is None else df.join(n.names, "container").withColumn("container", F.col("name")).drop("name")


def _around(own: DataFrame, *, after: bool) -> DataFrame:
    """The shared lines of ``own`` with the unique lines before (l1, at the ordinal segment) and ``after`` them (l2)."""
    by = Window.partitionBy("container", "language")
    hit = F.last(F.when(F.col("unique"), F.struct(F.col("ordinal").alias("o"), F.col("id").alias("l"))), ignorenulls=True)
    last, then = (hit.over(by.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)) for o in (F.asc("ordinal"), F.desc("ordinal")))
    own = own.withColumn("last", last)
    own = (own.withColumn("next", then) if after else own).where("not unique")
    rest = [F.col("last.o").alias("segment"), F.col("next.l").alias("l2")] if after else []
    return own.select("container", "language", "ordinal", "id", F.col("last.l").alias("l1"), *rest)


def _met(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (id, held, l) where the package held has line id under a file name that line l has.

    The unique line l is spread to its file names, as a shared line has many more of them."""
    spread = pairs.join(cache.select(F.col("line").alias("l"), "filename"), "l").select("id", "held", "l", "filename").distinct()
    here = cache.select(F.col("line").alias("id"), F.col("package").alias("held"), "filename")
    return spread.join(here, ["id", "held", "filename"], "left_semi").select("id", "held", "l").distinct()


def source_order(identifiers: DataFrame, cache: DataFrame) -> DataFrame:
    """(container, language, ordinal, line, package): shared lines assigned to the last unique match before them.

    ``identifiers`` has container, language, ordinal and line. A line of several packages is assigned to the package
    of the last unique line before it in the container when it shares that package and one of its file names."""
    return source_order_of(numbered(identifiers, cache))


def source_order_of(n: Numbered) -> DataFrame:
    """As ``source_order``. Whether two lines have a file name in common is found once for each pair of them."""
    rows = cut(_around(n.own, after=False).where("l1 is not null").distinct())
    only = n.facts.where("only is not null").select(F.col("id").alias("l"), F.col("only").alias("held"))
    pairs = rows.select("id", F.col("l1").alias("l")).distinct().join(only, "l")
    met = cut(_met(pairs, n.cache).select("id", F.col("l").alias("l1"), F.col("held").alias("package")))
    placed = cut(rows.join(met, ["id", "l1"]).drop("l1"))
    drop(rows, met)
    out = placed.join(n.lines.select("id", "line"), "id").select("container", "language", "ordinal", "line", "package")
    return _named(n, out)


def _placed(n: Numbered) -> DataFrame:
    """The shared lines of ``own`` with the rule that places them (way: forward, backward or null), the package they
    are placed in, the package they waited for (held) and the ordinal of the unique line before them (segment).

    Whether a line has a file name in common with a unique line is found once for each such pair of lines."""
    own = cut(_around(n.own, after=True))
    only = lambda l, c: n.facts.where("only is not null").select(F.col("id").alias(l), F.col("only").alias(c))  # noqa: E731, E741
    cases = own.select("id", "l1", "l2").where("l1 is not null").distinct().join(only("l1", "held"), "l1")
    cases = cut(cases.join(n.cache.select(F.col("line").alias("id"), F.col("package").alias("held")).distinct(), ["id", "held"], "left_semi"))
    met = cut(_met(cases.select("id", "held", F.explode(F.array("l1", "l2")).alias("l")).dropna().distinct(), n.cache))
    known = cases
    for k in (1, 2):
        known = known.join(met.select("id", "held", F.col("l").alias(f"l{k}"), F.lit(1).alias(f"met{k}")), ["id", "held", f"l{k}"], "left")
    known = cut(known.join(only("l2", "then"), "l2", "left"))
    drop(cases, met)
    same = (own.id == known.id) & (own.l1 == known.l1) & own.l2.eqNullSafe(known.l2)
    rows = own.join(known, same, "left").select(*[own[c] for c in ("container", "language", "ordinal", "id", "segment")], "held", "then", "met1", "met2", known.id.isNotNull().alias("waits"))
    waits = F.col("waits") & F.col("met1").isNull()
    run = Window.partitionBy("container", "language", "segment", waits).orderBy(F.desc("ordinal"))
    way = F.when(F.col("met1").isNotNull(), "forward").when(waits & (F.min(F.coalesce("met2", F.lit(0))).over(run) == 1), "backward")
    package = F.when(F.col("way") == "forward", F.col("held")).when(F.col("way") == "backward", F.col("then"))
    placed = cut(rows.withColumn("way", way).select("container", "language", "ordinal", "id", package.alias("package"), "way", "held", "segment"))
    drop(own, known)
    return placed


def direct_matches(identifiers: DataFrame, cache: DataFrame, *, cutoff: int = CUTOFF) -> DataFrame:
    """(container, language, ordinal, line, package, way): shared lines assigned by the unique lines around them.

    forward is the rule of source_order. A line that the package of the last unique line holds, but under none of the
    file names of that line, waits (backward): the next unique line goes back over the waiting lines and takes them for
    its own package as long as they have one of its file names in the package they waited for; the first that has none
    ends the run, and nothing waits any longer. Lines shorter than ``cutoff`` and unknown lines take no part."""
    return direct_matches_of(numbered(identifiers, cache, cutoff=max(cutoff, 1)))


def direct_matches_of(n: Numbered) -> DataFrame:
    """As ``direct_matches``; the cutoff is that of ``n``."""
    placed = _placed(n).where("way is not null").select("container", "language", "ordinal", "id", "package", "way")
    return _named(n, placed.join(n.lines.select("id", "line"), "id").select("container", "language", "ordinal", "line", "package", "way"))


def source_order_scores(identifiers: DataFrame, cache: DataFrame, averages: DataFrame, *, cutoff: int = CUTOFF) -> DataFrame:
    """(container, package, unique_score, nonunique_score, direct_score, same_file_score) in source order.

    Every occurrence of a line counts. Those assigned directly give their score to that package alone; the others
    are no clones or left to the greedy cover, where a line that was taken backwards since its last open occurrence has
    no part under the file names of the package it waited for. Packages with neither a unique nor a same-file score are left out."""
    return source_order_scores_of(numbered(identifiers, cache, cutoff=max(cutoff, 1)), averages)


def source_order_scores_of(n: Numbered, averages: DataFrame) -> DataFrame:
    """As ``source_order_scores``; the cutoff is that of ``n``."""
    key = ["container", "id"]
    cache = n.cache.withColumnRenamed("line", "id").drop("language")
    placed = _placed(n)
    taken = cut(placed.where("way is not null").groupBy(*key, "package").agg(F.count(F.lit(1)).alias("k")))
    newest = placed.where("way is null or way = 'backward'").groupBy(*key).agg(F.max("segment").alias("segment"))
    back = cut(placed.where("way = 'backward'").join(newest, [*key, "segment"]).select(*key, "language", F.col("held").alias("package")).distinct())
    drop(placed)
    left = F.col("n") - F.coalesce("n_direct", F.lit(0))
    lines = n.own.groupBy(*key, "language").agg(F.count(F.lit(1)).alias("n")).join(taken.groupBy(*key).agg(F.sum("k").alias("n_direct")), key, "left").withColumn("n", left).where("n > 0").drop("n_direct")
    classified = cut(_classed(lines.join(n.facts.drop("only"), "id").withColumn("ignored", F.lit(False)), F.col("length")))
    part = lambda df, u, o, e: df.select("container", "package", *[F.coalesce(x, F.lit(0.0)).alias(c) for x, c in ((u, "u"), (o, "o"), (e, "e"))])
    none, each = F.lit(None).cast("double"), F.col("n") * F.col("score")
    unique = part(classified.where("class = 'unique'"), each, none, none)
    other = part(classified.where("class = 'notclone'").select("container", "id", "n", "score").join(cache, "id"), none, each, none)
    shared = n.facts.select("id", (F.col("length") / F.pow(F.lit(ALPHA), F.col("n_filenames") - 1)).alias("shared"))
    direct = part(taken.join(shared, "id"), none, none, F.col("k") * F.col("shared"))
    scores = unique.unionByName(other).unionByName(direct).groupBy("container", "package").agg(F.sum("u").alias("unique_score"), F.sum("o").alias("nonunique_score"), F.sum("e").alias("direct_score"))
    scores = cut(scores)
    gone = back.join(cache, ["id", "package"]).select("container", "language", F.col("id").alias("line"), "filename").distinct()
    cover = greedy_cover(classified.withColumnRenamed("id", "line"), n.cache, scores, averages, gone=gone)
    return _named(n, scores.join(cover, ["container", "package"], "full").fillna(0.0, ["unique_score", "nonunique_score", "direct_score", "same_file_score"]).where("unique_score > 0 or same_file_score > 0"))


def first_variant(rows: DataFrame, key: Sequence[str], variants: Sequence[Column], known: DataFrame, column: str) -> DataFrame:
    """``rows`` (with the columns ``key``) joined to ``known`` by the first of ``variants`` that it has.

    Adds variant (its place) and ``column`` (its text). All variants meet ``known`` in one join, and the least place
    wins, so the cascade costs one shuffle however long it is. Rows without any match are left out."""
    every = F.posexplode(F.array(*variants)).alias("variant", column)
    tried = rows.select(*key, every).where(F.col(column).isNotNull() & (F.col(column) != ""))
    found = tried.join(known.select(column).distinct(), column, "left_semi")
    return found.groupBy(*key).agg(F.min(F.struct("variant", column)).alias("best")).select(*key, F.col("best.variant").alias("variant"), F.col(f"best.{column}").alias(column))


def kernel_variants(line: Column) -> list[Column]:
    """A kernel message as it is, without its level, after its first colon, and without a leading digit."""
    bare = F.regexp_replace(line, r"^<[\dcd]>", "")
    tail = F.when(F.instr(line, ":") > 0, F.regexp_replace(F.regexp_replace(line, r"^[^:]*:", ""), "^ ", ""))
    digit = F.when(line.rlike(r"^\d"), F.substring(line, 2, 2**31 - 1))
    return [line, F.when(bare != line, bare), tail, digit]


def class_variants(name: Column) -> list[Column]:
    """A class name without inner classes, and its last dotted part."""
    outer = F.element_at(F.split(name, r"\$"), 1)
    return [outer, F.substring_index(outer, ".", -1)]


def roll_up(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of contained files (child, package, score) summed for their containers (parent, child) and ranked."""
    sums = edges.select("parent", "child").distinct().join(scores, "child").groupBy("parent", "package").agg(F.sum("score").alias("score"))
    return rank(sums.withColumnRenamed("parent", "container"))
