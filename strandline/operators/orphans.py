"""References to records that do not exist.

References are grouped by the mask of their null key columns; each mask is anti-joined on its non-null columns
under the declared match semantics, as in SQL's MATCH clause:

* ``simple``: a reference with any null key column is satisfied;
* ``full``: all columns null is satisfied, some null is a violation by itself;
* ``partial``: all columns null is satisfied, else the non-null columns must agree with some target.

All masks take part in one pass: a target is projected onto each mask that occurs among the references.

Targets may be valid for a time only: a target counts for a reference when ``valid_from <= at < valid_to``, a
null ``valid_to`` having no end. Why a reference has no target is told apart: there is none of its key at all
(missing), only such as came later (late), or those there were are gone (deleted).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.skew import SALT, fan, hot_keys, replicated, salted

MATCHES = ("simple", "full", "partial")
_ROW, _MASK, _HASH, _AT, _TO, _KIND, _LASTS = "__row", "__mask", "__hash", "__at", "__to", "__kind", "__lasts"


@dataclass(frozen=True)
class Validity:
    """Names of the time column of the references and of the two bounds of the targets."""

    at: str
    valid_from: str
    valid_to: str


def orphans(references: DataFrame, targets: DataFrame, keys: Sequence[tuple[str, str]], *, match: str = "simple", validity: Validity | None = None, reason: str | None = None) -> DataFrame:
    """Rows of ``references`` whose key is found in no row of ``targets``, with all their columns.

    ``keys`` pairs the key columns of both sides. With ``reason`` a column of this name (replacing another) says missing,
    late, deleted, or incomplete for a partly null key under full. Cases: a reference without any non-null key column is
    never an orphan; empty and blank keys are ordinary values; repeated references come out once per row, repeated targets
    change nothing; without targets every complete reference is an orphan; a reference whose time is null meets nothing (it
    is late where there are targets of its key), and neither does a target without ``valid_from``; target columns never
    appear in the result, so equal names on both sides do not clash.

    Targets are reduced to one row per key and beginning. References and targets are put into one order of time per key,
    and what is valid at each reference is read off the targets before it, so a target costs one row however long it is
    valid. References of hot keys are spread over all parts.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    names = [f"__k{i}" for i in range(len(keys))]
    bits = [F.shiftleft(F.col(r).isNull().cast("int"), i) for i, (r, _) in enumerate(keys)]
    # The row travels as one column, so that no name of the references can clash with those used here.
    r = references.select(F.struct("*").alias(_ROW), reduce(lambda a, b: a + b, bits).alias(_MASK), *[F.col(c).alias(n) for n, (c, _) in zip(names, keys)])
    r = r.where(F.col(_MASK) < (1 << len(keys)) - 1)
    if match == "partial" and len(keys) > 1:
        masks = sorted(x[0] for x in r.select(_MASK).distinct().collect())
        found = _unmatched(r, targets, keys, names, masks, validity, reason)
    else:
        found = _unmatched(r.where(F.col(_MASK) == 0), targets, keys, names, [0], validity, reason)
    if match == "full":
        broken = r.where(F.col(_MASK) > 0)
        found = found.unionByName(broken.select(_ROW, F.lit("incomplete").alias("__reason")) if reason else broken.select(_ROW))
    if not reason:
        return found.select(f"{_ROW}.*")
    kept = [F.col(f"{_ROW}.`{c}`") for c in references.columns if c != reason]
    return found.select(*kept, F.col("__reason").alias(reason))


def _projected(targets: DataFrame, keys: Sequence[tuple[str, str]], names: Sequence[str], masks: Sequence[int], columns: Sequence) -> DataFrame:
    """The targets once for each mask for which all their other key columns are there, those of the mask set to null."""
    each = []
    for m in masks:
        held = [(n, F.col(t), not m >> i & 1) for i, (n, (_, t)) in enumerate(zip(names, keys))]
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for _, c, own in held if own])
        each.append(F.when(whole, F.struct(F.lit(m).alias(_MASK), *[F.when(F.lit(own), c).alias(n) for n, c, own in held])))
    return targets.select(F.explode(F.array_compact(F.array(*each))).alias("__x"), *columns).select("__x.*", *[c for c in (_AT, _TO) if columns])


def _unmatched(r: DataFrame, targets: DataFrame, keys: Sequence[tuple[str, str]], names: list[str], masks: Sequence[int], validity: Validity | None, reason: str | None) -> DataFrame:
    key = [_MASK, *names]
    hashed = lambda df: df.withColumn(_HASH, F.xxhash64(*key))  # noqa: E731 - two keys of one hash are salted alike
    # The order of times is that of the references; without times all targets come before all references.
    time = F.col(f"{_ROW}.{validity.at}") if validity else F.lit(None).cast("timestamp")
    stamp = dict(r.select(time.alias("t")).dtypes)["t"]
    kinds = dict(r.dtypes)
    r = hashed(r.withColumn(_AT, time))
    if validity:
        t = _projected(targets.where(F.col(validity.valid_from).isNotNull()), keys, names, masks, [F.col(validity.valid_from).cast(stamp).alias(_AT), F.col(validity.valid_to).cast(stamp).alias(_TO)])
        t = t.where(F.col(_TO).isNull() | (F.col(_TO) > F.col(_AT)))
        lasts = F.col(_TO).isNull()
        t = t.groupBy(*key, lasts.alias(_LASTS), F.when(~lasts, F.col(_AT)).alias("__from")).agg(F.min(_AT).alias(_AT), F.max(_TO).alias(_TO)).drop("__from")
    else:
        t = _projected(targets, keys, names, masks, []).distinct().select("*", F.lit(True).alias(_LASTS), F.lit(None).cast(stamp).alias(_AT), F.lit(None).cast(stamp).alias(_TO))
    t = t.select(_MASK, *[F.col(n).cast(kinds[n]).alias(n) for n in names], _LASTS, _AT, _TO)
    hot, parts = hot_keys(r.select(_HASH), _HASH), fan(r)
    row = r.schema[_ROW].dataType
    spread = F.struct(*[F.col(f"{_ROW}.`{f.name}`") for f in row.fields if not f.dataType.typeName().startswith("map")])
    a = salted(r, _HASH, hot, spread, parts).select(*key, SALT, _AT, F.lit(1).alias(_KIND), _ROW, F.lit(None).cast(stamp).alias(_TO), F.lit(False).alias(_LASTS))
    b = replicated(hashed(t), _HASH, hot, parts).select(*key, SALT, _AT, F.lit(0).alias(_KIND), F.lit(None).cast(row).alias(_ROW), _TO, _LASTS)
    by = Window.partitionBy(*key, SALT)
    before = by.orderBy(F.asc_nulls_first(_AT), _KIND).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until, lasting = F.max(_TO).over(before), F.max(_LASTS).over(before)
    own = a.unionByName(b).withColumn("__until", until).withColumn("__lasting", lasting)
    if reason:
        own = own.withColumn("__known", F.min(_KIND).over(by) == 0)
    own = own.where((F.col(_KIND) == 1) & ~(F.col("__lasting") | F.coalesce(F.col("__until") > F.col(_AT), F.lit(False))))
    if not reason:
        return own.select(_ROW)
    why = F.when(F.col("__until").isNotNull(), "deleted").when(F.col("__known"), "late").otherwise("missing")
    return own.select(_ROW, why.alias("__reason"))


def orphan_report(found: DataFrame, table: str = "table_name", at: str = "loaded_at", *by: str) -> DataFrame:
    """Orphans per table, month and further columns; a null time is reported under a null month."""
    return found.groupBy(table, F.date_format(F.col(at), "yyyy-MM").alias("month"), *by).agg(F.count(F.lit(1)).alias("orphans"))
