"""How often every distinct value occurs, in how many records, and which are too rare or too common.

Method: burst-trie counting. Distinct (term, record) pairs with their multiplicity are formed by a grouping on
both columns, which combines on the map side and spreads a hot term by its records. Each worker feeds its pairs to
burst tries; as every pair lies in one place, record counters may be added. The containers of the tries are then
routed by adaptive prefixes, and matching subtrees are merged, one route at a time, so a worker holds one subtree.
"""

from __future__ import annotations

import marshal
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.burst_trie import BurstTrie
from strandline.session import cut

#: Lengths in bytes at which a prefix that is still too heavy is made longer.
STEPS = (1, 2, 4, 8)
#: Terms a worker's tries may hold before their containers are sent on; bounds memory, has no influence on the result.
HELD_TERMS = 200_000
_BATCH = 100_000
_ROUTED = "field int, route binary, prefix binary, subtree binary"
_COUNTED = "field int, term binary, occurrences long, records long"


def heavy_prefixes(terms: DataFrame, routes: int) -> dict[bytes, int]:
    """Prefixes (of the lengths STEPS) that hold more than one in ``routes`` of the rows, and into how many routes
    those of the last length are divided. At most ``routes`` prefixes of each length can be that heavy, so the
    result is bounded whatever the input; counts are over all rows and combined on the map side. ``terms`` has the
    columns field (int) and term (binary)."""
    # One grouping at the longest step; the shorter prefixes are sums of its far fewer groups.
    longest = terms.groupBy("field", F.substring("term", 1, STEPS[-1]).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    prefix = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("p", 1, n).alias("p")) for n in STEPS]))
    counts = cut(longest.select("field", "c", prefix.alias("x")).groupBy("field", "x.n", "x.p").agg(F.sum("c").alias("c")))
    total = counts.where(F.col("n") == STEPS[0]).agg(F.sum("c")).first()[0] or 0
    limit = max(1, total // routes)
    rows = counts.where(F.col("c") > limit).collect()
    return {(r["field"], r["n"], bytes(r["p"])): -(-r["c"] // limit) for r in rows}


def _route(field: int, term: bytes, heavy: dict) -> bytes:
    for n in STEPS:
        prefix = term[:n]
        parts = heavy.get((field, n, prefix))
        if parts is None:
            return prefix
    return prefix + b"#%d" % (zlib.crc32(term) % parts)


def _routed_prefix(field: int, prefix: bytes, heavy: dict) -> bytes | None:
    """The route of all terms below a prefix, if they have one in common."""
    for n in STEPS:
        if len(prefix) < n:
            return None
        if (field, n, prefix[:n]) not in heavy:
            return prefix[:n]
    return None


def _grow(heavy: dict):
    def send(tries: dict[int, BurstTrie]) -> Iterator[pa.RecordBatch]:
        fields, routes, prefixes, subtrees = [], [], [], []

        def put(field, route, prefix, suffixes, counters):
            fields.append(field)
            routes.append(route)
            prefixes.append(prefix)
            subtrees.append(marshal.dumps((suffixes, [c[0] for c in counters], [c[1] for c in counters])))

        for field, trie in tries.items():
            for prefix, held in trie.containers():
                if (route := _routed_prefix(field, prefix, heavy)) is not None:
                    put(field, route, prefix, list(held), list(held.values()))
                    continue
                by: dict[bytes, list[bytes]] = {}
                for suffix in held:
                    by.setdefault(_route(field, prefix + suffix, heavy), []).append(suffix)
                for route, suffixes in by.items():
                    put(field, route, prefix, suffixes, [held[s] for s in suffixes])
        for i in range(0, len(fields), 2000):
            part = slice(i, i + 2000)
            yield pa.RecordBatch.from_arrays([pa.array(fields[part], pa.int32()), pa.array(routes[part], pa.binary()), pa.array(prefixes[part], pa.binary()), pa.array(subtrees[part], pa.binary())], ["field", "route", "prefix", "subtree"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {0: BurstTrie(), 1: BurstTrie()}
        waiting, rows = [], 0

        def feed():
            t = pa.Table.from_batches(waiting)
            for field, name in enumerate(("a", "b")):
                if name in t.column_names:
                    sums = t.group_by(name).aggregate([("n", "sum"), ("n", "count")])
                    add = tries[field].add
                    for term, occ, rec in zip(sums[name].to_pylist(), sums["n_sum"].to_pylist(), sums["n_count"].to_pylist()):
                        add(term, occ, rec)

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= _BATCH:
                feed()
                waiting, rows = [], 0
                if sum(t.size for t in tries.values()) > HELD_TERMS:
                    yield from send(tries)
                    tries = {0: BurstTrie(), 1: BurstTrie()}
        if rows:
            feed()
        yield from send(tries)

    return grow


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the subtrees of each route; its input is sorted by field and route."""
    at, trie = None, BurstTrie()

    def counted() -> Iterator[pa.RecordBatch]:
        terms, occ, rec = [], [], []
        for prefix, held in trie.containers():
            terms += [prefix + s for s in held]
            occ += [c[0] for c in held.values()]
            rec += [c[1] for c in held.values()]
            if len(terms) >= 20_000:
                yield _batch(at[0], terms, occ, rec)
                terms, occ, rec = [], [], []
        if terms:
            yield _batch(at[0], terms, occ, rec)

    for batch in batches:
        for field, route, prefix, subtree in zip(*[c.to_pylist() for c in batch.columns]):
            if (field, route) != at:
                if at is not None:
                    yield from counted()
                at, trie = (field, route), BurstTrie()
            for suffix, o, r in zip(*marshal.loads(subtree)):
                trie.add(prefix + suffix, o, r)
    if at is not None:
        yield from counted()


def _batch(field: int, terms: list, occ: list, rec: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([field] * len(terms), pa.int32()), pa.array(terms, pa.binary()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], ["field", "term", "occurrences", "records"])


def pair_counts(df: DataFrame, a: Column, b: Column | None, record: Column | None = None, *, routes: int | None = None) -> DataFrame:
    """Occurrences and distinct records of the terms of one or two columns.

    ``a`` and ``b`` are binary columns, each being the record of the other: field 0 of the result has the terms of
    ``a``, whose records are their distinct ``b``, field 1 the reverse. With ``b`` None only ``a`` is counted,
    against ``record``. Result: field int, term binary, occurrences long, records long, one row per distinct term.
    Rows in which either column is null take no part; empty terms are terms; repeated rows raise the occurrences
    only; an empty table gives an empty result; other columns of ``df`` have no influence, whatever their names.
    """
    other = b if b is not None else record
    rows = df.select(a.alias("a"), other.alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    terms = rows.select(F.lit(0).alias("field"), F.col("a").alias("term"))
    if b is not None:
        terms = terms.unionAll(rows.select(F.lit(1).alias("field"), F.col("b").alias("term")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_prefixes(terms, routes or 4 * parts)
    pairs = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    grown = (pairs if b is not None else pairs.select("a", "n")).mapInArrow(_grow(heavy), _ROUTED)
    return grown.repartition("field", "route").sortWithinPartitions("field", "route").mapInArrow(_merge, _COUNTED)


def mark(counts: DataFrame, common: Column, rare: int = 1) -> DataFrame:
    """Adds ``mark``: ``rare`` up to ``rare`` records, else ``common`` where the condition holds, else null."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare, F.lit("rare")).when(common, F.lit("common")))
