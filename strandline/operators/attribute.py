"""Versions, licences and other facts attributed to matched identifiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut, drop


def versions_of(matches: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """(container, package, line, version), distinct, of unique matches (container, package, language, line).

    ``facts`` has language, line and key, ``files`` key, package and version. The matches name their package, so
    they first pick its files' keys and then meet only these."""
    m = matches.select("container", "package", "language", "line").distinct()
    f = facts.select("language", "line", "key").dropna().distinct()
    v = files.select("key", "package", "version").dropna().distinct()
    return m.join(f, ["language", "line"]).join(v, ["key", "package"]).select("container", "package", "line", "version").distinct()


def licences_of(files: DataFrame, licences: DataFrame) -> DataFrame:
    """(key, licence, scanner), distinct: what each scanner says of the files (key). ``licences`` has key, licence and scanner."""
    own = licences.select("key", "licence", "scanner").where("key is not null and licence is not null").distinct()
    return own.join(files.select("key").distinct(), "key", "left_semi")


def copyrights_of(files: DataFrame, copyrights: DataFrame) -> DataFrame:
    """(key, copyright, type), distinct, of the files (key), without those of type statement.

    ``copyrights`` has key, copyright and type; a null type is no statement."""
    own = copyrights.select("key", "copyright", "type").where("key is not null and copyright is not null and not type <=> 'statement'").distinct()
    return own.join(files.select("key").distinct(), "key", "left_semi")


def version_histogram(versions: DataFrame) -> DataFrame:
    """(container, package, version, n_lines, place): distinct lines of each version, most first, then by version."""
    counts = versions.groupBy("container", "package", "version").agg(F.count(F.lit(1)).alias("n_lines"))
    place = F.row_number().over(Window.partitionBy("container", "package").orderBy(F.desc("n_lines"), "version"))
    return counts.withColumn("place", place)


def prune_versions(versions: DataFrame) -> DataFrame:
    """(container, package, version) without those whose set of lines is a proper part of another version's."""
    names = cut(_version_numbers(versions))
    rows = versions.join(names, ["package", "version"]).select("container", "package", "line", F.array("v").alias("vs"))
    return _maximal(rows).join(names, ["package", "v"]).select("container", "package", "version")


def _version_numbers(versions: DataFrame) -> DataFrame:
    """(package, version, v): the versions of each package, numbered from 0."""
    number = F.row_number().over(Window.partitionBy("package").orderBy("version")) - 1
    return versions.select("package", "version").distinct().withColumn("v", number)


def _maximal(rows: DataFrame) -> DataFrame:
    """(container, package, v): the versions whose lines are no proper part of another version's.

    ``rows`` has container, package, line and vs, an array of numbers of versions that have the line; a line may come in several rows. The
    versions that have every line of version v are the bits that all of its lines have in common; they are the same for
    v and for each of them exactly where none has a line that v lacks. So v stays when the versions with the same bits
    are as many as the bits, and neither pairs of versions nor sets of lines are built. One shuffle serves all steps."""
    keys = ["container", "package"]
    lines = rows.repartition(*keys).groupBy(*keys, "line").agg(F.array_distinct(F.flatten(F.collect_list("vs"))).alias("vs"))
    words = F.expr("transform(array_distinct(transform(vs, v -> shiftright(v, 6))), w -> named_struct('w', w, 'bits', aggregate(filter(vs, v -> shiftright(v, 6) = w), 0L, (x, v) -> x | shiftleft(1L, v & 63))))")
    each = lines.select(*keys, "vs", words.alias("words")).select(*keys, F.explode("vs").alias("v"), "words").select(*keys, "v", F.inline("words"))
    met = each.groupBy(*keys, "v", "w").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    met = met.groupBy(*keys, "v").agg(F.max("n").alias("n"), F.collect_list(F.struct("w", "bits", "n")).alias("all"))
    common = met.select(*keys, "v", F.expr("array_sort(transform(filter(all, x -> x.n = n AND x.bits != 0), x -> named_struct('w', x.w, 'bits', x.bits)))").alias("common"))
    same = common.groupBy(*keys, "common").agg(F.collect_list("v").alias("vs")).where(F.expr("size(vs) = aggregate(common, 0, (x, y) -> x + bit_count(y.bits))"))
    return same.select(*keys, F.explode("vs").alias("v"))


def matched_versions(strings: DataFrame, files: DataFrame, contents: DataFrame, *, cutoff: int) -> DataFrame:
    """(container, package, version): the maximal versions of the unique matches of each container, as ``prune_versions`` of ``versions_of`` gives them.

    ``strings`` has key, language and line, ``files`` key, package, version and filename, ``contents`` container and key.
    A line is unique to a package when the least and the greatest package of all its files are equal, so the cache is
    not built; keys, containers, lines and versions travel as numbers, and the versions of a line, which do not
    depend on the container, as one array, of no more versions than one package has."""
    known = F.when(F.col("filename").isNotNull(), F.col("package"))
    inside = contents.select("container", "key").dropna().distinct()
    own = files.where("key is not null").groupBy("key").agg(F.min(known).alias("least"), F.max(known).alias("most"))
    keys = cut(own.join(inside.select("key").distinct(), "key", "full").withColumn("file", F.monotonically_increasing_id()))
    number = keys.select("key", "file")
    versions = files.select("key", "package", "version").dropna().distinct()
    names = cut(_version_numbers(versions))
    held = cut(versions.join(number, "key").join(names, ["package", "version"]).select("file", "package", "v"))
    containers = cut(inside.select("container").distinct().withColumn("c", F.monotonically_increasing_id()))
    inside = cut(inside.join(number, "key").join(containers, "container").select("c", "file"))
    lines = strings.select("key", "language", "line").dropna().where(F.length("line") >= cutoff).distinct()
    lines = cut(lines.join(keys, "key").select("file", "language", "line", "least", "most"))
    drop(keys)
    unique = lines.groupBy("language", "line").agg(F.min("least").alias("package"), F.max("most").alias("most")).where("package = most")
    unique = unique.groupBy("line").agg(F.collect_list(F.struct("language", "package")).alias("all")).withColumn("text", F.monotonically_increasing_id())
    unique = cut(unique.select("line", "text", F.posexplode("all").alias("place", "x")).select("line", "text", "place", "x.language", "x.package"))
    single = lines.where("least is null or least = most").select("file", "language", "line")
    rows = cut(single.join(unique, ["language", "line"]).select("file", "text", "place", "package"))
    drop(lines, unique)
    sets = rows.join(held, ["file", "package"]).groupBy("text", "place").agg(F.collect_set("v").alias("vs"))
    met = rows.join(inside, "file").select("c", "package", "text", "place").distinct().join(sets, ["text", "place"])
    kept = cut(_maximal(met.select(F.col("c").alias("container"), "package", F.col("text").alias("line"), "vs")))
    drop(held, inside, rows)
    return kept.withColumnRenamed("container", "c").join(names, ["package", "v"]).join(containers, "c").select("container", "package", "version")


def row_versions(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(package, version, n): for each version, the distinct (name, key, linenumber) rows of its files.

    ``facts`` has name, key and linenumber; a null line number is a value of its own."""
    f = facts.select("name", "key", "linenumber").where("name is not null and key is not null").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    v = files.select("key", "package", "version").dropna().distinct()
    return v.join(f, "key").groupBy("package", "version").agg(F.sum("n").alias("n"))


def agreement(verdicts: DataFrame, left: str, right: str) -> DataFrame:
    """(verdict_left, verdict_right, n): the confusion matrix of two scanners over (key, scanner, verdict).

    A key that one of them did not judge counts under null on its side."""
    one = lambda s, c: verdicts.where(F.col("scanner") == s).select("key", F.col("verdict").alias(c)).distinct()
    both = one(left, "verdict_left").join(one(right, "verdict_right"), "key", "full")
    return both.groupBy("verdict_left", "verdict_right").agg(F.count(F.lit(1)).alias("n"))


def squash(verdicts: DataFrame, same: Mapping[str, str], left: str, right: str) -> DataFrame:
    """(key, scanner, verdict) in which a verdict of ``left`` and one of ``right`` that mean the same, by the table
    ``same``, become one of the scanner ``squashed``; other verdicts stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in same.items() for x in kv]) if same else F.create_map().cast("map<string,string>")
    own = verdicts.select("key", "scanner", "verdict").distinct()
    named = own.withColumn("meaning", F.when(F.col("scanner") == left, table[F.col("verdict")]).when(F.col("scanner") == right, F.col("verdict")))
    by = named.groupBy("key", "meaning").agg(F.count_distinct("scanner").alias("scanners"))
    joint = named.join(by, ["key", "meaning"], "left")
    agreed = F.coalesce(F.col("scanners") == 2, F.lit(False))
    return joint.select("key", F.when(agreed, "squashed").otherwise(F.col("scanner")).alias("scanner"), F.when(agreed, F.col("meaning")).otherwise(F.col("verdict")).alias("verdict")).distinct()
