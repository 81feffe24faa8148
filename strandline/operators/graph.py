"""Graphs of packages, libraries and symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import common_prefix
from strandline.session import cut


def closure(edges: DataFrame, *, most: int | None = None) -> DataFrame:
    """(src, dst, depth): all nodes that can be reached over one or more edges (src, dst), with the least depth.

    Each round joins the newest pairs with the edges and keeps those not met before, so circles end by themselves;
    each round's pairs are cut from their lineage. Rounds end when nothing new comes; with ``most``, pairs beyond that
    depth are an error."""
    base = cut(edges.select("src", "dst").dropna().distinct())
    found = base.withColumn("depth", F.lit(1))
    newest, depth = found, 1
    while True:
        depth += 1
        step = newest.select("src", F.col("dst").alias("mid")).join(base.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct()
        newest = cut(step.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            return found
        if most is not None and depth > most:
            raise ValueError(f"there are pairs at a distance above {most}")
        found = found.unionByName(newest)
        found = found if depth % 16 else cut(found)


def typed_closure(edges: DataFrame, *, most: int | None = None) -> DataFrame:
    """(src, dst, kind, n): for each start, how many edges of each kind (src, dst, kind) lie on what it reaches."""
    reach = closure(edges, most=most).select(F.col("src").alias("start"), F.col("dst").alias("src")).unionByName(edges.select(F.col("src").alias("start"), "src").distinct()).distinct()
    return reach.join(edges.distinct(), "src").groupBy(F.col("start").alias("src"), "kind").agg(F.count(F.lit(1)).alias("n"))


def resolved_links(links: DataFrame) -> DataFrame:
    """(path, target): where a chain of links (path, target) ends; links that run in a circle are left out.

    Each round doubles the steps taken, until all chains have ended or the steps are as many as there are links."""
    own = cut(links.select("path", "target").dropna().distinct())
    paths, steps, n = own.select(F.col("path").alias("target")).distinct(), 1, own.count()
    while steps < n:
        steps *= 2
        hop = own.select(F.col("path").alias("target"), F.col("target").alias("then"))
        step = own.join(hop, "target", "left").groupBy("path", F.coalesce("then", "target").alias("target")).agg(F.max(F.col("then").isNotNull()).alias("moved"))
        step = cut(step)
        own = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return own.join(paths, "target", "left_anti").select("path", "target")


def library_files(needed: DataFrame, files: DataFrame, links: DataFrame, sonames: DataFrame) -> DataFrame:
    """(library, path, way) for each needed library: the file of its name, else the file a link of its name leads to,
    else the only file that declares it as its name; way is name, link, soname or unresolved.

    ``files`` has path and name, ``links`` name and path, ``sonames`` soname and path. Of several the least path wins."""
    want = needed.select("library").dropna().distinct()
    only = sonames.groupBy(F.col("soname").alias("library")).agg(F.min("path").alias("path"), F.count_distinct("path").alias("n")).where("n = 1")
    ways = files.select(F.col("name").alias("library"), "path", F.lit(0).alias("k")).unionByName(links.select(F.col("name").alias("library"), "path", F.lit(1).alias("k"))).unionByName(only.select("library", "path", F.lit(2).alias("k")))
    best = want.join(ways, "library").groupBy("library").agg(F.min(F.struct("k", "path")).alias("b"))
    k = F.col("b.k")
    way = F.when(F.col("b").isNull(), "unresolved").when(k == 0, "name").when(k == 1, "link").otherwise("soname")
    return want.join(best, "library", "left").select("library", F.col("b.path").alias("path"), way.alias("way"))


def resolved_symbols(undefined: DataFrame, defined: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, symbol, kind, library, pass): which declared library gives each undefined symbol.

    ``undefined`` has file, symbol, kind and weak, ``defined`` library, symbol, kind and weak, ``declared`` file and
    library. Strong symbols look for strong ones first, then for weak ones; weak symbols likewise, in passes 3 and 4."""
    met = undefined.join(declared, "file").join(defined.withColumnRenamed("weak", "weak_there"), ["library", "symbol", "kind"])
    order = F.when(~F.col("weak"), 1).otherwise(3) + F.col("weak_there").cast("int")
    best = met.groupBy("file", "symbol", "kind").agg(F.min(F.struct(order.alias("p"), "library")).alias("b"))
    return best.select("file", "symbol", "kind", F.col("b.library").alias("library"), F.col("b.p").alias("pass"))


def library_use(declared: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file, library, symbols, used): how many symbols each declared library gives a file."""
    n = resolved.groupBy("file", "library").agg(F.count(F.lit(1)).alias("symbols"))
    return declared.select("file", "library").distinct().join(n, ["file", "library"], "left").select("file", "library", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.col("symbols").isNotNull().alias("used"))


def nearest_provider(users: DataFrame, providers: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope..., symbol, path, provider, common): the provider of a symbol in the same scope whose path has the
    longest common prefix with the user's; ties by path. No file provides for itself."""
    own = users.select(*scope, "symbol", "path").distinct()
    other = providers.select(*scope, "symbol", F.col("path").alias("provider")).distinct()
    met = own.join(other, [*scope, "symbol"]).where("path != provider").withColumn("common", common_prefix(F.col("path"), F.col("provider")))
    best = met.groupBy(*scope, "symbol", "path").agg(F.min(F.struct((-F.col("common")).alias("c"), "provider")).alias("b"))
    return best.select(*scope, "symbol", "path", F.col("b.provider").alias("provider"), (-F.col("b.c")).cast("int").alias("common"))


def symbol_types(symbols: DataFrame) -> DataFrame:
    """(version, symbol, type): the one type a symbol is known with, else undecided."""
    n = symbols.groupBy("version", "symbol").agg(F.count_distinct("type").alias("n"), F.min("type").alias("one"))
    return n.select("version", "symbol", F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, "undecided").otherwise("unknown").alias("type"))


def narrowed_types(wanted: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(package, version, symbol, type): the type of each wanted symbol (package, version, symbol) as of that version.

    A symbol known with one type in ``symbols`` (key, symbol, type) has it, and one known with none is unknown. Of
    several types that in the files (key, package, version) of the package in the same version counts, else, where
    that version lacks the symbol, that in the version before the first '-'; undecided if this is not a single type."""
    found = symbols.select("key", "symbol", "type").dropna()
    types = (F.min("type").alias("least"), F.max("type").alias("most"))
    key = ["package", "version", "symbol"]
    held = cut(found.join(files.select("key", "package", "version").dropna().distinct(), "key").groupBy(*key).agg(*types))
    own = cut(wanted.select(*key).distinct().join(held, key, "left"))
    single = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("undecided")
    # What the same version holds decides, also for a symbol of one type in all; only the others go on.
    open_ = own.where("least is null").select(*key, F.when(F.contains("version", F.lit("-")), F.substring_index("version", "-", 1)).alias("before"))
    every = found.groupBy("symbol").agg(*types).select("symbol", single.alias("every"))
    base = held.select("package", F.col("version").alias("before"), "symbol", single.alias("base"))
    open_ = open_.join(every, "symbol", "left").join(base, ["package", "before", "symbol"], "left")
    kind = F.when(F.col("every").isNull(), "unknown").when(F.col("every") != "undecided", F.col("every")).otherwise(F.coalesce("base", F.lit("undecided")))
    return own.where("least is not null").select(*key, single.alias("type")).unionByName(open_.select(*key, kind.alias("type")))


def licence_conflicts(edges: DataFrame, licences: DataFrame, symbol_type: str = "gplkernelsymbol") -> DataFrame:
    """Edges (src, dst, type) over symbols for GPL modules only, from modules none of whose licences (file, licence)
    is a GPL."""
    gpl = licences.groupBy(F.col("file").alias("src")).agg(F.max(F.contains("licence", F.lit("GPL")).cast("int")).alias("gpl"))
    return edges.where(F.col("type") == symbol_type).join(gpl, "src", "left").where("coalesce(gpl, 0) = 0").select("src", "dst", "type")


def equivalent(members: DataFrame) -> DataFrame:
    """(key, group, n_members, group_size): keys with equal sets of members (key, member); group is the least key.

    Sets are compared by their size and two sums of hashes that merge on the map side, so no set is ever built."""
    own = members.select("key", "member").dropna().distinct()
    marks = own.groupBy("key").agg(F.count(F.lit(1)).alias("n_members"), F.bit_xor(F.xxhash64("member")).alias("x"), F.sum(F.xxhash64(F.lit(7), "member").cast("decimal(38,0)")).alias("s"))
    groups = marks.groupBy("n_members", "x", "s").agg(F.min("key").alias("group"), F.count(F.lit(1)).alias("group_size"))
    return marks.join(groups, ["n_members", "x", "s"]).select("key", "group", "n_members", "group_size")


def other_versions(modules: DataFrame, kernels: DataFrame) -> DataFrame:
    """Modules (module, version) whose version is that of no kernel (version)."""
    return modules.join(kernels.select("version").distinct(), "version", "left_anti").select("module", "version")


def ranked_by_rule(df: DataFrame, group: Sequence[str], order: Sequence, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def library_edges(declared: DataFrame, resolved: DataFrame, undefined: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(file, library, kind): used for declared libraries that give a symbol, unused for others, and knowninterface
    (without a library) for files all of whose unresolved symbols belong to known interfaces (symbol)."""
    use = library_use(declared, resolved).select("file", "library", F.when(F.col("used"), "used").otherwise("unused").alias("kind"))
    open_ = undefined.select("file", "symbol").distinct().join(resolved.select("file", "symbol"), ["file", "symbol"], "left_anti")
    known = open_.join(interfaces.select("symbol").distinct().withColumn("known", F.lit(1)), "symbol", "left")
    all_known = known.groupBy("file").agg(F.min(F.coalesce("known", F.lit(0))).alias("k")).where("k = 1")
    return use.unionByName(all_known.select("file", F.lit(None).cast("string").alias("library"), F.lit("knowninterface").alias("kind")))


def undeclared_edges(undefined: DataFrame, resolved: DataFrame, defined: DataFrame) -> DataFrame:
    """(file, library, symbols): libraries that a file does not declare but that alone define symbols it leaves open.

    ``undefined`` has file, symbol and kind, ``resolved`` the symbols that declared libraries give, ``defined`` library,
    symbol and kind. A symbol that several libraries define says nothing."""
    key = ["symbol", "kind"]
    only = defined.select("library", *key).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("library").alias("library")).where("n = 1").drop("n")
    open_ = undefined.select("file", *key).distinct().join(resolved.select("file", *key), ["file", *key], "left_anti")
    return open_.join(only, key).where("file != library").groupBy("file", "library").agg(F.count(F.lit(1)).alias("symbols"))


def plugin_uses(plugins: DataFrame, undefined: DataFrame, defined: DataFrame) -> DataFrame:
    """(plugin, host, symbols): how many symbols that a plugin leaves undefined each host program defines.

    ``plugins`` has file, ``undefined`` file and symbol, ``defined`` file and symbol."""
    own = undefined.join(plugins.select("file").distinct(), "file").select(F.col("file").alias("plugin"), "symbol").distinct()
    host = defined.join(plugins.select("file").distinct(), "file", "left_anti").select(F.col("file").alias("host"), "symbol").distinct()
    return own.join(host, "symbol").groupBy("plugin", "host").agg(F.count(F.lit(1)).alias("symbols"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, type, n): symbols behind each edge, by type."""
    return edges.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))
