"""Mapping freely typed names to the entries of a reference list.

Method: a BK-tree over the reference entries under the Levenshtein metric. A query descends only into the subtrees
that the triangle inequality leaves open, and gets every entry within the threshold. A small reference is sent to
all workers; a larger one is divided into shards, each query meets the tree of every shard, and the winners merge.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import SALT, fan, hot_keys, replicated, salted, workers
from strandline.session import cut

#: Entries of a reference that is sent whole to every worker (a few MB as a tree), and entries of a shard beyond it.
WHOLE_ENTRIES = SHARD_ENTRIES = 50_000
#: Distinct old names whose chains are followed on the driver; those of more are followed by doubling steps in tables.
RENAMES = 50_000
#: Distinct names that meet the tree of one shard in one group.
GROUP_NAMES = 100_000

# What typists and packagers put around a name, and letters that look like others.
ENDINGS = ("-dev", "-devel", "-src", "-bin", "-common", "-doc", "-dbg")
BEGINNINGS = ("lib", "py-", "python-")
LOOKALIKES = str.maketrans("аеорсхуіјѕԁһкмтοανρικ", "aeopcxyijsdhkmtoavpik")
_ARCHIVE = re.compile(r"\.(?:tar|tar\.(?:gz|bz2|xz|lzma|zst)|tgz|tbz2|txz|zip)$")
_VERSION = re.compile(r"(?:[-_ ]+v?|[-_ ]*\(v?)\d+(?:[._]\d+)*(?:[-_.~+]?(?:rc\d*|alpha\d*|beta\d*|b|dfsg\d*))*\)?$")
_ORIGIN = re.compile(r"(?:\.orig|[+~.]dfsg\d*|\.git)$")
_PROJECT = re.compile(r"^the (.*) project$")
_DOMAIN = re.compile(r"^(?:org|net|com|io)\.(?:.*\.)?([^.]+)$")
_AROUND = " .,;:\"'()[]<>`"


def fold(name: str) -> str:
    """A name without case, accents, width and lookalike letters, white space around it and wrapping characters."""
    text = unicodedata.normalize("NFKD", name)
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold().translate(LOOKALIKES)
    text = " ".join(text.split()).strip(_AROUND)
    return _PROJECT.sub(r"\1", text).strip(_AROUND)


def forms(name: str) -> list[str]:
    """The forms under which a name may stand in the reference, the fullest first."""
    text = fold(name)
    out = [text]
    while True:
        bare = _ORIGIN.sub("", _ARCHIVE.sub("", text))
        bare = _VERSION.sub("", bare).strip(_AROUND)
        if bare == text or not bare:
            break
        text = bare
        out.append(text)
    if found := _DOMAIN.match(text):
        text = found[1]
        out.append(text)
    text = re.sub(r"[ _-]+", "-", text)
    out.append(text)
    for ending in ENDINGS:
        if text.endswith(ending) and len(text) > len(ending):
            text = text[: -len(ending)]
            out.append(text)
            break
    for beginning in BEGINNINGS:
        if text.startswith(beginning) and len(text) > len(beginning):
            out.append(text[len(beginning) :])
    return [x for x in dict.fromkeys(out) if x]


class Pattern:
    """A text whose Levenshtein distance to others is taken bit-parallel."""

    __slots__ = ("bits", "size", "text")

    def __init__(self, text: str):
        self.text, self.size = text, len(text)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def distance(self, other: str) -> int:
        m = self.size
        if not m:
            return len(other)
        full, top = (1 << m) - 1, 1 << m - 1
        plus, minus, score, get = full, 0, m, self.bits.get
        for c in other:
            eq = get(c, 0)
            v = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(h | plus)
            down = plus & h
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 | 1
            plus = (down << 1 | ~(v | up)) & full
            minus = up & v & full
        return score


class BKTree:
    """Texts by their distances; ``within`` finds all within a radius."""

    def __init__(self, texts: Sequence[str]):
        self._root = None
        for t in texts:
            self._add(t)

    def _add(self, text: str) -> None:
        if self._root is None:
            self._root = (text, {})
            return
        own, node = Pattern(text), self._root
        while d := own.distance(node[0]):
            if d not in node[1]:
                node[1][d] = (text, {})
                return
            node = node[1][d]

    def within(self, text: str, radius: int) -> list[tuple[int, str]]:
        out, own, stack = [], Pattern(text), [self._root] if self._root else []
        while stack:
            held, children = stack.pop()
            d = own.distance(held)
            if d <= radius:
                out.append((d, held))
            for edge, child in children.items():
                if -radius <= edge - d <= radius:
                    stack.append(child)
        return out


def transposed_distance(a: str, b: str) -> int:
    """Damerau's distance with adjacent swaps as one step, to tell apart entries at equal Levenshtein distance."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def radius_of(text: str, most: int) -> int:
    """The threshold for a form: ``most``, but less for short ones, of which too much would be left to chance."""
    return min(most, max(0, (len(text) - 1) // 2 - 1))


class Matcher:
    """Finds the best entry of a list for a name: exact forms first, then the nearest within the threshold."""

    def __init__(self, entries: Sequence[str], most: int):
        self._exact: dict[str, str] = {}
        for e in sorted(entries, key=lambda e: (fold(e) != e, e)):
            for form in (fold(e), re.sub(r"[ _-]+", "-", fold(e))):
                if form:
                    self._exact.setdefault(form, e)
        self._tree, self._most = BKTree(list(self._exact)), most

    def best(self, name: str) -> tuple[int, int, int, bool, str] | None:
        """(distance, distance with swaps, place of the form, whether the entry is not in folded spelling, entry); the
        least is the best."""
        own, found = forms(name), None
        for k, form in enumerate(own):
            if form in self._exact:
                return 0, 0, k, *self._ranked(form)
        for k, form in enumerate(own):
            for d, held in self._tree.within(form, radius_of(form, self._most)):
                if found is None or d <= found[0]:
                    new = d, transposed_distance(form, held), k, *self._ranked(held)
                    found = new if found is None else min(found, new)
        return found

    def _ranked(self, form: str) -> tuple[bool, str]:
        entry = self._exact[form]
        return fold(entry) != entry, entry


_matchers: dict[str, Matcher] = {}


def _matcher(token: str, listed, most: int) -> Matcher:
    """The matcher of a broadcast list, built once by each worker process."""
    if token not in _matchers:
        _matchers.clear()
        _matchers[token] = Matcher(listed.value, most)
    return _matchers[token]


_MATCH = "name string, distance int, swaps int, form int, unfolded boolean, entry string"


def match_names(names: DataFrame, entries: DataFrame, *, most: int = 2, whole: int = WHOLE_ENTRIES, shard: int = SHARD_ENTRIES) -> DataFrame:
    """(name, entry, distance): the best entry of each distinct non-null ``name``, entry null where there is none.

    ``entries`` has the string column entry. A name equals an entry when one of its forms does (see ``forms``); else
    the entry within ``most`` edits wins: by distance, then by distance with swaps, then by the fullest form, then an
    entry in folded spelling before others, then by the entry itself. Empty names have no entry; null entries and repeated entries have no influence; without
    entries no name has one.
    """
    distinct = names.select("name").where("name is not null").distinct()
    held = entries.select("entry").where("entry is not null").distinct()
    n = held.count()
    if n <= whole:
        listed, token = names.sparkSession.sparkContext.broadcast([r[0] for r in held.collect()]), uuid.uuid4().hex

        def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield _matched(frame["name"], _matcher(token, listed, most))

        found = distinct.repartition(workers(names), F.xxhash64("name")).mapInPandas(match, _MATCH)
    else:
        shards = -(-n // shard)
        salts = max(1, -(-distinct.count() // GROUP_NAMES))
        asked = distinct.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        kept = held.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def meet(own: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            return _matched(own["name"], Matcher(list(tree["entry"]), most))

        found = asked.groupBy("shard", "salt").cogroup(kept.groupBy("shard", "salt")).applyInPandas(meet, _MATCH)
    # An exact form beats every nearer-looking other, and a fuller exact form a barer one.
    order = F.struct("distance", "swaps", "form", "unfolded", "entry")
    best = found.where("entry is not null").groupBy("name").agg(F.min(order).alias("best"))
    return distinct.join(best, "name", "left").select("name", F.col("best.entry").alias("entry"), F.col("best.distance").alias("distance"))


def _matched(names: pd.Series, matcher: Matcher) -> pd.DataFrame:
    rows = [(n, *(b if (b := matcher.best(n)) else (None,) * 5)) for n in names]
    out = pd.DataFrame(rows, columns=["name", "distance", "swaps", "form", "unfolded", "entry"])
    return out.astype({"distance": "Int32", "swaps": "Int32", "form": "Int32", "unfolded": "boolean"})


def map_names(values: DataFrame, name: str, reference: DataFrame, renames: DataFrame, *, most: int = 2) -> DataFrame:
    """``values`` with ``entry_id``: the id of the reference entry that the string column ``name`` stands for, 0 if none.

    ``reference`` has entry_id and entry, ``renames`` row_id, old and new. A name that is an old name, in whatever
    spelling, stands for what the new one stands for, to the end of the chain; of several renames of one old name
    that of the least row_id holds; a null new name, or a circle without any entry in it, leads nowhere; a circle
    through an entry (a name "renamed" to another spelling of itself) ends at it: where the chain comes into the circle, else
    at the entry of the least key on it. Null names get a null id. Rows of
    one name that holds much of the table are spread when the results are joined back. Another column entry_id is
    replaced.
    """
    values = values.drop("entry_id")
    own = reference.where("entry is not null").groupBy("entry").agg(F.min("entry_id").alias("entry_id"))
    keyed = cut(own.withColumn("k", _key("entry")))
    links = _resolved(keyed, renames, most)
    olds = renames.where("old is not null").select(F.col("old").alias("entry"))
    entries = own.select("entry").unionByName(olds).distinct()
    names = values.select(F.col(name).alias("name"))
    found = match_names(names, entries, most=most)
    # An entry that is also an old name stands for the new one.
    ids = entries.withColumn("k", _key("entry")).join(own, "entry", "left").join(links, "k", "left").select("entry", F.coalesce("linked", "entry_id").alias("entry_id"))
    of = found.join(ids, "entry", "left").select(F.col("name").alias(name), F.coalesce("entry_id", F.lit(0)).alias("entry_id"))
    hot, parts = hot_keys(names, "name"), fan(values)
    spread = F.monotonically_increasing_id()
    rows = values.where(F.col(name).isNotNull())
    out = salted(rows, name, hot, spread, parts).join(replicated(of, name, hot, parts), [name, SALT]).select(*values.columns, "entry_id")
    return out.unionByName(values.where(F.col(name).isNull()).withColumn("entry_id", F.lit(None).cast("long")))


def _key(column: str):
    """What the spellings of one name have in common: its fullest form."""
    return F.pandas_udf(lambda names: names.map(lambda n: None if n is None else (forms(n) or [""])[0]), "string")(column)


def _resolved(keyed: DataFrame, renames: DataFrame, most: int, limit: int = RENAMES) -> DataFrame:
    """(k, linked): the entry id at the end of the chain of each old name, by the name's key; 0 if it leads nowhere."""
    rows = cut(renames.where("old is not null").select("row_id", _key("old").alias("k"), "old", "new"))
    first = rows.groupBy("k").agg(F.min_by("new", "row_id").alias("new"))
    entries = rows.select(F.col("old").alias("entry")).unionByName(keyed.select("entry"))
    to = match_names(first.select(F.col("new").alias("name")), entries, most=most).where("entry is not null")
    to = to.withColumn("at", _key("entry")).select(F.col("name").alias("new"), "at")
    step = cut(first.join(to, "new", "left").select("k", "at"))
    ids = keyed.groupBy("k").agg(F.min("entry_id").alias("id"))
    return _followed(step, ids) if step.count() <= limit else _doubled(step, ids)


def _followed(step: DataFrame, ids: DataFrame) -> DataFrame:
    """The ends of few chains (k, at), on the driver."""
    to = {r["k"]: r["at"] for r in step.collect()}
    nodes = ids.sparkSession.createDataFrame([(x,) for x in {*to, *to.values()} - {None}], "k string")
    own = {r["k"]: r["id"] for r in ids.join(nodes, "k", "left_semi").collect()}
    out = []
    for k in to:
        at, been = k, {}
        while at in to and at not in been:
            been[at] = len(been)
            at = to[at]
        circle = sorted(x for x, i in been.items() if i >= been[at]) if at in been else []
        out.append((k, own.get(at) or next((own[x] for x in circle if x in own), 0)))
    return ids.sparkSession.createDataFrame(out, "k string, linked long")


def _doubled(step: DataFrame, ids: DataFrame) -> DataFrame:
    """The same for any number of chains: every round doubles the steps taken, until all chains have ended or the steps
    are as many as there are links, when what still goes on goes round in circles."""

    def doubled(own: DataFrame, n: int) -> DataFrame:
        taken = 1
        while taken < n:
            taken *= 2
            hop = own.select(F.col("k").alias("at"), F.col("at").alias("then"), F.col("least").alias("further"), F.lit(True).alias("on"))
            own = cut(own.join(hop, "at", "left").select("k", F.when(F.col("on"), F.col("then")).otherwise(F.col("at")).alias("at"), F.least("least", "further").alias("least"), F.coalesce("on", F.lit(False)).alias("on")))
            if own.where("on").isEmpty():
                break
            own = own.drop("on")
        return own.select("k", "at", "least")

    n = step.count()
    named = ids.withColumnRenamed("k", "at")
    links = cut(step.join(ids, "k", "left").select("k", "at", F.when(F.col("id").isNotNull(), F.col("k")).alias("least")))
    far = cut(doubled(links, n))
    round_ = far.join(step.select(F.col("k").alias("at")), "at", "left_semi")
    ended = far.join(step.select(F.col("k").alias("at")), "at", "left_anti").join(named, "at", "left").select("k", "id")
    circle = cut(round_.select(F.col("at").alias("k")).distinct())
    # Where each chain comes into its circle: the links of the circles' own nodes are taken away.
    tails = round_.select("k").join(circle, "k", "left_anti").join(links, "k")
    into = doubled(cut(tails), n).select("k", "at").unionByName(circle.select("k", F.col("k").alias("at")))
    least = far.select(F.col("k").alias("at"), "least").join(ids.select(F.col("k").alias("least"), F.col("id").alias("other")), "least").select("at", "other")
    met = into.join(named, "at", "left").join(least, "at", "left").select("k", F.coalesce("id", "other").alias("id"))
    return ended.unionByName(met).select("k", F.coalesce("id", F.lit(0)).alias("linked"))
