"""Long exact spans that texts have in common.

Sliding spans of a fixed length are hashed (polynomial hashes over all characters, so each span costs a few array
operations), joined globally, and repeated ones give pairs of texts, passages, shares and the sentences to remove.

Sentences as such cannot give every common run of a stated length: such a run may begin and end inside sentences
and hold none whole. So the spans are not runs of whole sentences but stretches of ``span`` characters chosen by
winnowing: of every ``length - span + 1`` neighbouring stretches the one of the least hash is kept. The choice
depends on those characters alone, so every common run of ``length`` characters brings at least one common span, and
all of the run lies within ``length - span`` characters of it on either side.

That is why no two texts need to be compared: a repeated span takes these characters around it along (its variant), and
two texts have a common run around it just when their variants agree on enough of them. Texts that have the same variant
are linked without any comparison; the variants of one span are compared in pairs while they are few, else by the hashes
of all their stretches of the full length, so no span costs more than its own rows however many texts hold it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.skew import SALT, fan, hot_keys, replicated, salted
from strandline.session import cut

#: Characters that are hashed at a time.
CHUNK = 1 << 19
#: Variants of one span that are compared in pairs, and hot spans that are told apart (at most).
WIDE, HOT_SPANS = 32, 256
_SENTENCE = re.compile(r"\S(?:[^\n\r.!?…。！？]|[.!?…](?![\s.!?…]|\Z)|[.!?…。！？](?=[.!?…。！？]))*[.!?…。！？]?")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n + 1, _BASE), np.full(n + 1, inverse)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Hashes of all stretches of a length in an array of code points."""

    def __init__(self):
        self._up, self._down = _powers(1 << 12)

    def __call__(self, points: np.ndarray, length: int) -> np.ndarray:
        n = len(points)
        if n < length:
            return np.zeros(0, np.uint64)
        if n >= len(self._up):
            self._up, self._down = _powers(2 * n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self._up[:n], dtype=np.uint64)])
            h = (sums[length:] - sums[: n - length + 1]) * self._down[: n - length + 1]
            for m in _MIX:
                h = (h ^ (h >> np.uint64(31))) * m
            return h ^ (h >> np.uint64(30))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnowed(hashes: np.ndarray, window: int, ends: np.ndarray, span: int) -> np.ndarray:
    """Places of the leftmost least hash of every ``window`` neighbours that lie in one text, ascending.

    ``hashes`` are those of all stretches of ``span`` characters of texts set one behind the other, ``ends`` the ends
    of the texts, each of which has room for a window."""
    n = len(hashes)
    # Hash in front, place behind: values are distinct and the leftmost of equal hashes is least. Places are told
    # apart modulo 2 ** 24, many times the window.
    low = np.uint64((1 << 24) - 1)
    if window >= 1 << 22:
        raise ValueError("the window is too wide")
    value = (hashes & ~low) | (np.arange(n, dtype=np.uint64) & low)
    least, have = value, 1
    while have * 2 <= window:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < window:
        rest = window - have
        least = np.minimum(least[:-rest], least[rest:])
    start = np.arange(len(least))
    own = ends[np.searchsorted(ends, start, "right")]
    start, least = (x[start + window - 1 + span <= own] for x in (start, least))
    at = start + ((least.astype(np.int64) - start) & int(low))
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def _chosen(points: np.ndarray, ends: np.ndarray, span: int, window: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed stretches of texts set one behind the other. A single text longer than CHUNK is
    taken in pieces that overlap by what one window covers, so that every window lies in a piece."""
    if len(ends) > 1 or len(points) <= CHUNK:
        h = hasher(points, span)
        at = winnowed(h, window, ends, span)
        return at, h[at]
    covered, places, hashes = window + span - 1, [], []
    for start in range(0, len(points) - covered + 1, CHUNK):
        piece = points[start : start + CHUNK + covered - 1]
        at, h = _chosen_piece(piece, span, window, hasher)
        places.append(at + start)
        hashes.append(h)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _chosen_piece(points: np.ndarray, span: int, window: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    h = hasher(points, span)
    at = winnowed(h, window, np.array([len(points)]), span)
    return at, h[at]


def _parts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` characters; a longer text is alone."""
    at = 0
    ends = np.cumsum(lengths)
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def spans(texts: DataFrame, length: int, span: int) -> DataFrame:
    """(doc_id, hash, at): the winnowed spans of texts (doc_id, digest, text) of at least ``length`` characters, ``digest``
    being their md5. Copies of a text that the worker has met already are passed over."""
    window = length - span + 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, met = Hasher(), set()
        for batch in batches:
            digests = batch.column(1).to_pylist()
            new = [i for i, x in enumerate(digests) if x not in met and not met.add(x)]
            if len(met) > 1_000_000:
                met.clear()
            if not new:
                continue
            own = batch.take(pa.array(new))
            lengths, ids = pc.utf8_length(own.column(2)).to_numpy().astype(np.int64), own.column(0).to_numpy()
            for lo, hi in _parts(lengths, CHUNK):
                ends = np.cumsum(lengths[lo:hi])
                at, h = _chosen(code_points("".join(own.column(2)[lo:hi].to_pylist())), ends, span, window, hasher)
                text = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][text], pa.int64()), pa.array(h.view(np.int64)), pa.array(at - (ends - lengths[lo:hi])[text], pa.int32())], ["doc_id", "hash", "at"])

    return texts.select("doc_id", "digest", "text").mapInArrow(hashed, "doc_id long, hash long, at int")


def classes_of(documents: DataFrame, length: int) -> DataFrame:
    """(doc_id, class_id) of the documents of at least ``length`` characters; equal texts have the least doc_id of them
    as class_id."""
    own = documents.where(F.length("text") >= length).select("doc_id", F.unhex(F.md5("text")).alias("m"))
    least = own.groupBy("m").agg(F.min("doc_id").alias("class_id"))
    hot, parts = hot_keys(own, "m"), fan(documents)
    return salted(own, "m", hot, F.col("doc_id"), parts).join(replicated(least, "m", hot, parts), ["m", SALT]).select("doc_id", "class_id")


def _hot_spans(found: DataFrame) -> list[int]:
    """Hashes that hold so many rows that one part of a shuffle would be uneven; a bounded sketch per worker, merged. Which
    hashes are in the list has no influence on the result."""
    rows = found.count()
    least = max(1000, rows // (8 * fan(found)))
    top = found.agg(F.expr(f"approx_top_k(hash, {HOT_SPANS}, {64 * HOT_SPANS})").alias("top")).first()["top"] if rows else []
    return [r["item"] for r in top or [] if r["count"] > least]


def shared_spans(documents: DataFrame, *, length: int = 200, span: int = 120) -> tuple[DataFrame, DataFrame]:
    """(classes: doc_id, class_id; members: hash, v, class_id, at, left, around, before, step).

    ``documents`` has doc_id (long, unique) and text. Texts of at least ``length`` characters are put into classes of
    equal texts, named by their least doc_id; shorter, empty and null texts have no class, as they can share no such
    run. ``members`` has the repeated spans of each class: where they are, and ``around``, the text up to
    ``length - span`` characters on either side, in which the span begins at ``left``; v names this variant; before and
    step tell the repeated span before it that it touches, and how far back that begins. Other columns of the documents
    have no influence; without documents both results are empty.

    Hashes and places are shuffled once by hash, those of hot spans not at all; each text with a repeated span travels once.
    """
    docs = documents.select("doc_id", "text").where(F.length("text") >= length)
    classes = cut(classes_of(docs, length))
    found = cut(spans(docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text"), length, span))
    hot = _hot_spans(found)
    by = Window.partitionBy("hash")
    cold = found.where(~F.col("hash").isin(hot)) if hot else found
    met = cold.withColumn("more", F.min("doc_id").over(by) != F.max("doc_id").over(by)).where("more").drop("more")
    met = met.unionByName(found.where(F.col("hash").isin(hot))) if hot else met
    met = met.join(classes, "doc_id").select("class_id", "at", "hash").distinct()
    kept = met.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("kept"))
    own = docs.join(kept.withColumnRenamed("class_id", "doc_id"), "doc_id").select("doc_id", "text", "kept")
    pad = length - span

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32())
        names = ["hash", "class_id", "at", "left", "around", "before", "step"]
        for batch in batches:
            rows = []
            for doc, text, spans_ in zip(*[c.to_pylist() for c in batch.columns]):
                last = None
                for x in spans_:
                    at, h = x["at"], x["hash"]
                    touches = last is not None and at - last[0] <= span
                    rows.append((h, doc, at, min(at, pad), text[max(0, at - pad) : at + span + pad], last[1] if touches else None, at - last[0] if touches else None))
                    last = at, h
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    members = own.mapInArrow(around, "hash long, class_id long, at int, left int, around string, before long, step int")
    return classes, cut(members.withColumn("v", F.unhex(F.md5(F.concat_ws(":", "left", "around")))))


def _agreement(a: str, i: int, b: str, j: int, span: int, pad: int) -> tuple[int, int] | None:
    """How many characters before and behind their span (at i and j) two variants agree on; None for different spans."""
    if a[i : i + span] != b[j : j + span]:
        return None
    left = min(i, j)
    x, y = a[i - left : i], b[j - left : j]
    while x != y:
        # The agreement ends behind the last place where they differ.
        k = max(k for k in range(len(x)) if x[k] != y[k])
        x, y = x[k + 1 :], y[k + 1 :]
    right = a[i + span :], b[j + span :]
    r = len(commonprefix(right))
    return len(x), r


def variant_links(members: DataFrame, *, length: int = 200, span: int = 120, wide: int = WIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants: hash, v, around, left, first, last, n; links: hash, v, w, l, r; windows: hash, v, j, key, before).

    ``links`` has the pairs of variants of one span that agree on at least ``length`` characters, l before the span and r
    behind it, in both directions, and each variant of that length with itself; all those of spans of at most ``wide``
    variants, and beyond only the latter. ``windows`` has the stretches of ``length`` characters of the variants of the
    other spans: two of them are linked when they have a key in common. first and last are the least and the greatest
    class of a variant."""
    own = members.groupBy("hash", "v").agg(F.first("around").alias("around"), F.first("left").alias("left"), F.min("class_id").alias("first"), F.max("class_id").alias("last"))
    own = cut(own)
    hot, parts = hot_keys(own, "hash"), fan(members)
    counts = replicated(own.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hash", hot, parts)
    variants = cut(salted(own, "hash", hot, F.col("v"), parts).join(counts, ["hash", SALT], "left").drop(SALT).withColumn("n", F.coalesce("n", F.lit(1))))
    same = variants.where(F.length("around") >= length).select("hash", "v", F.col("v").alias("w"), F.col("left").alias("l"), (F.length("around") - F.col("left") - span).alias("r"))
    few = variants.where(F.col("n").between(2, wide)).select("hash", "v", "around", "left")
    pairs = few.join(few.withColumnsRenamed({"v": "w", "around": "other", "left": "at"}), "hash").where("v < w")
    pad = length - span

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, v, a, i, w, b, j in zip(*[c.to_pylist() for c in batch.columns]):
                if (found := _agreement(a, i, b, j, span, pad)) and found[0] + found[1] >= pad:
                    rows += [(h, v, w, *found), (h, w, v, *found)]
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["hash", "v", "w", "l", "r"])

    near = pairs.select("hash", "v", "around", "left", "w", "other", "at").mapInArrow(compare, "hash long, v binary, w binary, l int, r int")
    at = F.explode(F.sequence(F.lit(0), F.length("around") - length))
    key = lambda j: F.xxhash64(F.substring("around", j + 1, F.lit(length)))
    many = variants.where((F.col("n") > wide) & (F.length("around") >= length)).select("hash", "v", "left", "first", "last", "around", at.alias("j"))
    windows = many.select("hash", "v", "left", "first", "last", "j", key(F.col("j")).alias("key"), F.when(F.col("j") > 0, key(F.col("j") - 1)).alias("before"))
    return variants, cut(same.unionByName(near)), windows


def class_links(members: DataFrame, *, length: int = 200, span: int = 120, wide: int = WIDE) -> DataFrame:
    """(class_a, class_b), class_a < class_b, distinct: the classes of texts with a common run of ``length`` characters.

    A pair comes out of the joins once per common run, not once per span: where the touching span before is the same in
    both, it has brought the pair already. Members of a hot variant are spread over all parts."""
    _, links, windows = variant_links(members, length=length, span=span, wide=wide)
    parts = fan(members)
    group = F.xxhash64("hash", "v")
    key = ["hash", "key"]
    far = windows.withColumn("g", F.xxhash64(*key))
    hot = hot_keys(far, "g")
    a, b = salted(far, "g", hot, F.col("v"), parts), replicated(far, "g", hot, parts)
    b = b.select(*key, SALT, F.col("v").alias("w"), F.col("before").alias("before_w"))
    far = a.join(b, [*key, SALT]).where("v < w and not coalesce(before = before_w, false)").select("hash", "v", "w").distinct()
    every = links.where("v <= w").select("hash", "v", "w").unionByName(far)
    own = members.select("hash", "v", "class_id", "before", "step").withColumn("g", group)
    hot = hot_keys(own, "g")
    one = salted(own, "g", hot, F.col("class_id"), parts).select("hash", "v", SALT, F.col("class_id").alias("x"), "before", "step")
    other = own.select("hash", F.col("v").alias("w"), F.col("class_id").alias("y"), F.col("before").alias("before_y"), F.col("step").alias("step_y"))
    links_at = replicated(every.withColumn("g", group), "g", hot, parts).drop("g")
    to = links_at.join(one, ["hash", "v", SALT]).drop(SALT)
    # The other end: rows of the hot variants on both sides are spread by the first.
    g = F.xxhash64("hash", "w")
    to = salted(to.withColumn("g", g), "g", hot, F.col("x"), parts).drop("g")
    other = replicated(other.withColumn("g", g), "g", hot, parts).drop("g")
    met = to.join(other, ["hash", "w", SALT]).where("x != y and (v != w or x < y) and not coalesce(before = before_y and step = step_y, false)")
    return met.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct()


def document_pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of documents with a common run, copies among themselves included."""
    hot, parts = hot_keys(classes, "class_id"), fan(classes)
    left = salted(classes, "class_id", hot, F.col("doc_id"), parts)
    right = replicated(classes, "class_id", hot, parts).withColumnRenamed("doc_id", "y")
    copies = left.withColumnRenamed("doc_id", "x").join(right, ["class_id", SALT]).where("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"))

    def expanded(pairs: DataFrame, column: str, name: str) -> DataFrame:
        many = left.withColumnsRenamed({"class_id": column, "doc_id": name})
        return replicated(pairs, column, hot, parts).join(many, [column, SALT]).drop(SALT)

    met = expanded(expanded(links.select("class_a", "class_b"), "class_a", "x"), "class_b", "y")
    return copies.unionByName(met.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")))


def class_sizes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies, links): of each document its class, how many documents have the same text, and with how
    many other classes that text shares a run. One row per document, whatever the number of pairs."""
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    own = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies")).join(ends, "class_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    hot, parts = hot_keys(classes, "class_id"), fan(classes)
    return salted(classes, "class_id", hot, F.col("doc_id"), parts).join(replicated(own, "class_id", hot, parts), ["class_id", SALT]).select("doc_id", "class_id", "copies", "links")


def _merged(rows: DataFrame, key: list[str]) -> DataFrame:
    """Stretches (key, from, to), those that overlap or touch joined up."""
    by = Window.partitionBy(*key).orderBy("from", "to")
    before = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = rows.withColumn("new", F.when(F.col("from") <= before, 0).otherwise(1)).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*key, "part").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("part")


def passages(classes: DataFrame, members: DataFrame, documents: DataFrame, *, length: int = 200, span: int = 120, wide: int = WIDE) -> DataFrame:
    """(doc_id, kind, from, to): the maximal stretches of each document that are made of runs of at least ``length``
    characters found in another document (kind shared) or in one of lower doc_id (kind repeated: all but the first).

    No pairs are formed: a run of a text is found elsewhere when the least or the greatest class of a linked variant is
    another one, and repeated when the least is lower."""
    variants, links, windows = variant_links(members, length=length, span=span, wide=wide)
    ends = variants.select("hash", F.col("v").alias("w"), F.col("first").alias("least"), F.col("last").alias("most"))
    near = links.join(ends, ["hash", "w"]).select("hash", "v", "l", (F.col("r") + span).alias("r"), "least", "most")
    far = windows.groupBy("hash", "key").agg(F.min("first").alias("least"), F.max("last").alias("most")).where("least != most")
    g, parts = F.xxhash64("hash", "key"), fan(members)
    hot = hot_keys(windows.withColumn("g", g), "g")
    far = salted(windows.withColumn("g", g), "g", hot, F.col("v"), parts).join(replicated(far.withColumn("g", g), "g", hot, parts).drop("g"), ["hash", "key", SALT])
    far = far.select("hash", "v", (F.col("left") - F.col("j")).alias("l"), (F.col("j") - F.col("left") + length).alias("r"), "least", "most")
    extents = near.unionByName(far).distinct()
    own = members.select("hash", "v", "class_id", "at").withColumn("g", F.xxhash64("hash", "v"))
    hot = hot_keys(own, "g")
    extents = replicated(extents.withColumn("g", F.xxhash64("hash", "v")), "g", hot, parts).drop("g")
    met = salted(own, "g", hot, F.col("class_id"), parts).join(extents, ["hash", "v", SALT]).where("least != class_id or most != class_id")
    kinds = F.explode(F.when(F.col("least") < F.col("class_id"), F.array(F.lit("shared"), F.lit("repeated"))).otherwise(F.array(F.lit("shared"))))
    rows = met.select("class_id", kinds.alias("kind"), (F.col("at") - F.col("l")).alias("from"), (F.col("at") + F.col("r")).alias("to")).distinct()
    parts_of = _merged(rows, ["class_id", "kind"])
    # Copies share the whole text, which all but the first repeat.
    copies = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    hot = hot_keys(classes, "class_id")
    spread = lambda: salted(classes, "class_id", hot, F.col("doc_id"), parts)
    copied = spread().join(replicated(copies, "class_id", hot, parts), ["class_id", SALT]).select("doc_id", "class_id")
    sizes = documents.select("doc_id", F.length("text").alias("to"))
    whole = copied.join(sizes, "doc_id").select("doc_id", F.explode(F.when(F.col("doc_id") == F.col("class_id"), F.array(F.lit("shared"))).otherwise(F.array(F.lit("shared"), F.lit("repeated")))).alias("kind"), F.lit(0).alias("from"), "to")
    own = spread().join(replicated(parts_of, "class_id", hot, parts), ["class_id", SALT]).select("doc_id", "kind", "from", "to")
    return own.join(whole.select("doc_id", "kind"), ["doc_id", "kind"], "left_anti").unionByName(whole)


def shares(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, repeated_chars): how much of each document lies in passages found elsewhere,
    and how much in such as a document of lower id has too; 0 for documents without any, null for null texts."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("to") - F.col("from")).otherwise(0)).alias(f"{kind}_chars")
    sums = found.groupBy("doc_id").agg(n("shared"), n("repeated"))
    out = documents.select("doc_id", F.length("text").cast("long").alias("n_chars")).join(sums, "doc_id", "left")
    here = F.col("n_chars").isNotNull()
    return out.select("doc_id", "n_chars", *[F.when(here, F.coalesce(c, F.lit(0))).alias(c) for c in ("shared_chars", "repeated_chars")])


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(from, to) of the sentences of a text: they end behind a mark of the end with blanks or nothing behind it, or at a
    line end; blanks around them belong to none."""
    for m in _SENTENCE.finditer(text):
        yield m.span()


def repeated_sentences(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, from, to): the sentences that lie wholly in passages which a document of lower id has too: what is to be
    removed so that only the first of each long run stays. ``found`` are the passages of the documents."""
    runs = found.where("kind = 'repeated'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own in zip(*[c.to_pylist() for c in batch.columns]):
                k = 0
                for a, b in sentences(text):
                    while k < len(own) and own[k]["to"] < b:
                        k += 1
                    if k < len(own) and own[k]["from"] <= a:
                        rows.append((doc, a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "from", "to"])

    return documents.select("doc_id", "text").join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(covered, "doc_id long, from int, to int")
