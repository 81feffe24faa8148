"""How distinctive a term is of each record (here: of each owner of files), by residual inverse document frequency.

ridf(s) = observed idf - the idf expected if the occurrences of s fell on the owners at random (Poisson), that is
``-log2(df / D) + log2(1 - exp(-cf / D))`` with cf the occurrences (files that hold s, counted per owner), df the
owners that have s and D all owners. weight(s, p) = n(s, p) * ridf(s): a term spread evenly gets about 0, a term
concentrated in few owners a high weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.skew import SALT, fan, hot_keys, replicated, salted

_OWNED = ("owner", "file")
_HELD = ("file", "term")


def term_weights(owned: DataFrame, held: DataFrame) -> DataFrame:
    """Weight of every term of every owner.

    ``owned`` has the columns owner and file, ``held`` file and term; other columns have no influence. Result, one
    row per pair with at least one common file: owner, term, n_pair (files of the owner that hold the term), n_term
    (files that hold it), n_owner (files of the owner), n_files (all files), owners (that have the term), weight.
    Rows with a null in a needed column take no part; empty strings are ordinary values; repeated rows count once;
    a file of several owners counts for each of them, and once in n_term and n_files; without rows the result is empty.

    The strings are shuffled once by file (rows of hot files are spread by term, which keeps duplicates together),
    made distinct there and joined in place; all later steps work on counts per term and owner.
    """
    o = owned.select(*_OWNED).where("owner is not null and file is not null").distinct()
    h = held.select(*_HELD).where("file is not null and term is not null")
    hot, parts = hot_keys(h, "file"), fan(held)
    n_files = o.agg(F.count_distinct("file")).first()[0]
    n_owners = o.agg(F.count_distinct("owner")).first()[0]
    sizes = o.groupBy("owner").agg(F.count(F.lit(1)).alias("n_owner"))
    # One owner of each file is its first, so that files are counted once.
    first = o.groupBy("file").agg(F.min("owner").alias("first"))
    flagged = o.join(first, "file").select("file", "owner", (F.col("owner") == F.col("first")).cast("long").alias("lead"))
    h = salted(h, "file", hot, F.col("term"), parts).repartition("file", SALT).dropDuplicates(["file", SALT, "term"])
    met = h.join(replicated(flagged, "file", hot, parts), ["file", SALT])
    pairs = met.groupBy("term", "owner").agg(F.count(F.lit(1)).alias("n_pair"), F.sum("lead").alias("lead"))
    # A term has at most one row per owner here, however many files hold it.
    by = Window.partitionBy("term")
    pairs = pairs.select("term", "owner", "n_pair", F.sum("lead").over(by).alias("n_term"), F.sum("n_pair").over(by).alias("cf"), F.count(F.lit(1)).over(by).alias("owners"))
    d = F.lit(float(max(n_owners, 1)))
    ridf = F.log2(F.lit(1.0) - F.exp(-F.col("cf") / d)) - F.log2(F.col("owners") / d)
    # Owners of many files have many terms: their pairs are spread.
    hot = hot_keys(o, "owner")
    met = salted(pairs, "owner", hot, F.col("term"), parts).join(replicated(sizes, "owner", hot, parts), ["owner", SALT])
    return met.select("owner", "term", "n_pair", "n_term", "n_owner", F.lit(n_files).cast("long").alias("n_files"), "owners", (F.col("n_pair") * ridf).alias("weight"))
