"""Mixing sources to target weights, repeating documents of small sources up to a limit.

Method: hash-threshold histograms. The copies a source needs are whole rounds of all its documents, and one more copy
of those whose hash lies below a threshold. Sizes are summed by source and hash bucket; the running sums give the
bucket in which the budget ends; only that bucket is divided again, by the next bits of the hash, until it holds one
document. The documents are then chosen by a comparison with the threshold, without any sort, and a larger budget
always chooses a superset. Budgets and thresholds are tables with a row per source, however many sources there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.skew import SALT, fan, hot_keys, replicated, salted
from strandline.session import cut

_BITS = 10
#: Bits of the 63-bit hash that each level leaves out, and a threshold above all hashes.
_SHIFTS, _ALL = (53, 43, 33, 23, 13, 3, 0), 2**63 - 1


def mix(documents: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(chosen: doc_id, source, n_ids, copies; report: one row per target source).

    ``documents`` has doc_id, source and n_ids (the size), ``targets`` source, weight and max_repeat, one row per
    source. The budget of a source is weight * ``total``, which defaults to the size of all documents of the target
    sources. A document is used ``copies`` times, at most max_repeat (null or below 1: not at all). The chosen size
    of a source misses its budget by less than the next document's size, unless all its documents are used as often
    as allowed: then it falls short, as does a source without documents. Documents of size 0 belong to whole rounds
    and to their place under the threshold like any other. Documents whose source is null or no target, or whose
    size is null, are not used; a null weight is 0. Documents of one and the same hash are taken or left together.

    The report has source, weight, max_repeat, documents, available (size of one copy of all), budget, chosen
    (size), share (of all that is chosen; null when nothing is), shortfall (budget - chosen where the source is used
    up, else 0) and short (whether it is).
    """
    want = cut(targets.where("source is not null").groupBy("source").agg(F.max("weight").cast("double").alias("weight"), F.max("max_repeat").cast("int").alias("max_repeat")))
    # 63 bits, so that hashes and thresholds are non-negative longs.
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)
    docs = documents.select("doc_id", "source", F.col("n_ids").cast("long").alias("n_ids"), hashed.alias("h")).where("source is not null and n_ids is not null")
    docs = cut(docs)
    hot, parts = hot_keys(docs, "source"), fan(documents)
    spread = cut(salted(docs, "source", hot, F.col("doc_id"), parts)) if hot else docs.withColumn(SALT, F.lit(0))

    def with_source(table: DataFrame) -> DataFrame:
        """The documents of the sources of a table, with its columns."""
        return spread.join(replicated(table, "source", hot, parts), ["source", SALT]).drop(SALT)

    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_ids").alias("available"))
    plan = cut(want.join(sizes, "source", "left").fillna(0, ["documents", "available"]))
    if total is None:
        total = plan.agg(F.sum("available")).first()[0] or 0
    plan = plan.withColumn("budget", F.coalesce("weight", F.lit(0.0)) * F.lit(total))
    most = F.greatest(F.lit(0), F.coalesce("max_repeat", F.lit(0)))
    rounds = F.when(F.col("available") > 0, F.least(most, F.floor(F.col("budget") / F.col("available")).cast("long"))).otherwise(most).cast("int")
    state = plan.select("source", rounds.alias("rounds"), (F.col("budget") - rounds * F.col("available")).alias("left"), (rounds < most).alias("open"))
    state = cut(state)
    settled = state.where("not open").select("source", "rounds", F.lit(0).cast("long").alias("below"))
    open_ = state.where("open").select("source", "rounds", "left", F.lit(None).cast("long").alias("prefix"))
    before = None
    for shift in _SHIFTS:
        inside = with_source(open_.select("source", "prefix"))
        if before is not None:
            inside = inside.where(F.col("prefix") == F.shiftrightunsigned("h", before))
        sums = inside.groupBy("source", F.shiftrightunsigned("h", shift).alias("b")).agg(F.sum("n_ids").alias("size"), F.count(F.lit(1)).alias("n"))
        # At most 2 ** _BITS rows of each source meet here.
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        over = sums.withColumn("upto", upto).join(open_.select("source", "left"), "source").where("upto > left")
        first = over.groupBy("source").agg(F.min_by(F.struct("b", "n", (F.col("upto") - F.col("size")).alias("passed")), "b").alias("x"))
        own = cut(open_.select("source", "rounds", "left").join(first, "source", "left"))
        further = F.col("x").isNotNull() & (F.col("x.n") > 1) & F.lit(shift > 0)
        below = F.when(F.col("x").isNull(), F.lit(_ALL)).otherwise(F.shiftleft("x.b", shift))
        settled = settled.unionByName(own.where(~further).select("source", "rounds", below.alias("below")))
        open_ = own.where(further).select("source", "rounds", (F.col("left") - F.col("x.passed")).alias("left"), F.col("x.b").alias("prefix"))
        before = shift
        if open_.isEmpty():
            break
    settled = cut(settled)
    copies = F.col("rounds") + (F.col("h") < F.col("below")).cast("int")
    chosen = with_source(settled).select("doc_id", "source", "n_ids", copies.alias("copies")).where("copies > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_ids") * F.col("copies")).alias("chosen"), F.min("copies").alias("least"), F.count(F.lit(1)).alias("used"))
    report = plan.join(used, "source", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))
    short = (F.col("chosen") < F.col("budget")) & ((F.col("documents") == 0) | (F.coalesce("max_repeat", F.lit(0)) < 1) | ((F.col("used") == F.col("documents")) & (F.col("least") >= F.col("max_repeat"))))
    share = F.try_divide(F.col("chosen"), used.agg(F.sum("chosen")).scalar())
    weight = F.coalesce("weight", F.lit(0.0)).alias("weight")
    return chosen, report.select(
        "source", weight, "max_repeat", "documents", "available", "budget", "chosen", share.alias("share"), F.when(short, F.col("budget") - F.col("chosen")).otherwise(F.lit(0.0)).alias("shortfall"), F.coalesce(short, F.lit(False)).alias("short")
    )
