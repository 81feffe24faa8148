"""Per-key results that do not pile up on the few keys that hold most rows.

Ranks are selected exactly without gathering the values of a key: the values of each key are counted into a
histogram of fixed width, whose counts merge on the map side; the bucket that holds a wanted rank is known from
the running counts; and only buckets whose content is not yet a single value are histogrammed again, over their
own range, until every rank is resolved. A key contributes at most ``buckets`` rows per round to a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.skew import SALT, fan, hot_keys, replicated, salted
from strandline.session import cut

#: Unresolved ranks are broadcast up to this size in bytes, which is measured first; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def ranks(df: DataFrame, key: str, value: str, wanted: Sequence[float], *, buckets: int = 1024) -> DataFrame:
    """Exact per-key order statistics of the integer column ``value``: rows (key, f, n, value).

    ``wanted`` has fractions in [0, 1]; fraction f stands for the value of rank ``max(1, ceil(f * n))`` among the n
    non-null values of the key, so 0 is the least and 1 the greatest. Null keys and null values take no part; ties
    need no order, as equal values are equal results; a key with a single row has it for every rank; an empty table
    gives an empty result.
    """
    data = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("long").alias("v"))
    span = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0, 0)
    width = (hi - lo) // buckets + 1
    first = data.groupBy("k", F.expr(f"(v - {lo}L) div {width}L").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    whole = Window.partitionBy("k")
    upto = F.sum("c").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = first.withColumn("upto", upto).withColumn("n", F.sum("c").over(whole))
    fractions = F.array(*[F.lit(float(f)) for f in wanted])
    asked = F.explode(F.transform(fractions, lambda f: F.struct(f.alias("f"), F.greatest(F.lit(1), F.ceil(f * F.col("n"))).cast("long").alias("rank"))))
    hit = counted.withColumn("q", asked).select("k", F.col("q.f").alias("f"), "n", F.col("q.rank").alias("rank"), "c", "lo", "hi", "upto")
    state, out, hot = cut(_settle(hit)), None, None
    while True:
        done, open_ = state.where("v is not null").select("k", "f", "n", "v"), state.where("v is null").drop("v")
        out = done if out is None else out.unionByName(done)
        left = open_.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("k").cast("string"))).alias("bytes")).first()
        if not left["n"]:
            return out.select(F.col("k").alias(key), "f", "n", F.col("v").alias(value))
        # lo and hi are values that occur and differ, and the rank lies strictly between theirs.
        asked = open_.select("k", "f", "n", "rank", F.col("lo").alias("from"), F.col("hi").alias("to"), F.expr(f"(hi - lo) div {buckets}L + 1").alias("w"))
        if left["bytes"] + 80 * left["n"] <= BROADCAST_BYTES:
            met = data.join(F.broadcast(asked), "k")
        else:
            hot = hot_keys(data, "k") if hot is None else hot
            met = salted(data, "k", hot, F.col("v"), fan(df)).join(replicated(asked, "k", hot, fan(df)), ["k", SALT])
        again = met.where("v between from and to").groupBy("k", "f", "n", "rank", F.expr("(v - from) div w").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("k", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        state = cut(_settle(again.withColumn("upto", upto)))


def _settle(hit: DataFrame) -> DataFrame:
    """Keeps the bucket that holds the rank; the rank within it, and the value where the bucket decides it."""
    inner = F.col("rank") - (F.col("upto") - F.col("c"))
    value = F.when((F.col("lo") == F.col("hi")) | (inner == 1), F.col("lo")).when(inner == F.col("c"), F.col("hi"))
    return hit.where((inner >= 1) & (inner <= F.col("c"))).select("k", "f", "n", inner.alias("rank"), "lo", "hi", value.alias("v"))


def key_profile(df: DataFrame, key: str, record: str, at: str, *, middle: Sequence[float] = (0.5,), buckets: int = 1024) -> DataFrame:
    """Rows, distinct records, first time and time quantiles of every key.

    Result: key, n_rows, n_records, first_at, and ``at_<percent>`` for each fraction of ``middle``. Rows with a null
    key take no part; null records and null times count as rows but are neither records nor times. Empty keys are
    ordinary keys. Distinct records are counted in two steps, first by key and record, then by key, so the rows of
    a hot key are spread by its records and arrive pre-aggregated. Rows are those counted by the ranks and those
    without a time.
    """
    own = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(record).alias("r"), F.expr(f"unix_micros(cast(`{at}` as timestamp))").alias("t"))
    pairs = own.groupBy("k", "r").agg(F.count_if(F.col("t").isNull()).alias("c"))
    sums = pairs.groupBy("k").agg(F.sum("c").alias("timeless"), F.count("r").alias("n_records"))
    stamp = lambda c: F.timestamp_micros(c).cast(dict(df.dtypes)[at])
    names = {0.0: "first_at"} | {float(f): f"at_{round(100 * f)}" for f in middle}
    wide = ranks(own, "k", "t", list(names), buckets=buckets).groupBy("k").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("f") == f, stamp(F.col("t")))).alias(n) for f, n in names.items()])
    return sums.join(wide, "k", "left").select(F.col("k").alias(key), (F.coalesce("n", F.lit(0)) + F.col("timeless")).alias("n_rows"), "n_records", *names.values())


def heavy_keys(profile: DataFrame, key: str, rows: int, one_in: int) -> DataFrame:
    """The keys of a profile that hold at least one in ``one_in`` of ``rows``; there are at most ``one_in`` of them."""
    return profile.where(F.col("n_rows") * one_in >= F.lit(rows)).select(key, "n_rows")
