"""Telling hand-written source of a package from generated, minified, vendored files and data kept as code.

Method: character n-gram models of identifiers, one per language, are trained on all clean file heads. A file whose names have
a cross-entropy far above that of clean files, each held out from the counts it is measured by, has mangled names (minified); a file with hardly any distinct
names in its text has low diversity (data stored as code, tables written by tools), one whose names are few once their
digits are taken out follows a template (generated); comments that speak like those in files with a tool's name or
directory, by a model of the words of either kind, and fixed phrases and names mark generated files; and directories that bear
the name of another package mark foreign files: below a directory for such copies, or with content which that other
package lists too. Only the last kind depends on who holds a file, so the original of a copy is never marked.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import SALT, fan, hot_keys, replicated, salted
from strandline.session import cut

#: A file is mangled beyond this many standard deviations of clean files, and poor in names below this share of their mean.
DEVIATIONS, POOR = 6.0, 0.25
#: Heads with less code than these characters say nothing of their density.
SHORT = 80
#: Languages with fewer clean heads than these have neither a model nor limits of their own.
LEAST_HEADS = 20
#: Heads that are measured together, and names, which bound the memory where heads are long; neither changes a result.
HEADS_AT_ONCE, NAMES_AT_ONCE = 512, 1 << 14
#: Names of which at least this share is a repetition but for digits follow a template, if there are so many.
TEMPLATE, TEMPLATE_NAMES = 0.5, 8
#: Slots of the counts of words in comments, and log odds (by the root of the words) beyond which a comment is a tool's.
COMMENT_SLOTS, COMMENT_MARGIN = 1 << 16, 4.0

# Extensions of languages, directories for copies of others, and what tools leave in names and comments.
LANGUAGES = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "java": "java", "js": "js", "ts": "js", "py": "python", "php": "php", "rb": "ruby", "cs": "csharp", "go": "go", "rs": "rust", "pl": "perl", "scala": "java", "kt": "java", "as": "js",
}
COPIES = ("third_party", "third-party", "thirdparty", "3rdparty", "3rdpart", "3rd_party", "vendor", "vendors", "vendored", "external", "externals", "extern", "node_modules", "bower_components", "godeps", "bundled", "subprojects", "deps")
MAYBE_COPIES = ("ext", "exts", "contrib")
PASSED = ("_workspace", "src", "dist", "lib")
TOOL_DIRECTORIES = ("gen", "generated", "autogen", "generated-sources", "generated_sources", "generated-src", "__generated__")
TOOL_NAMES = r"(?i)(?:^(?:moc_|ui_|qrc_|lex\.)|(?:\.|_)generated\.[^.]+$|\.(?:tab|yy|pb|g|designer)\.[^.]+$|_(?:pb2|pb2_grpc|wrap)\.[^.]+$|_autogen\.[^.]+$)"
SHRUNK_NAMES = r"(?i)(?:[._-](?:min|pack|packed|bundle)\.[^.]+$)"
OPENINGS = re.compile(
    r"do not (?:edit|modify|change)|don't edit|ne pas modifier|nicht (?:bearbeiten|ändern)|no (?:editar|modificar)"
    r"|(?:changes|edits|modifications)\b[^.\n]{0,30}\b(?:will be lost|vanish|are lost|be overwritten)"
    r"|\bedit \S+ instead|@generated\b|\bauto-?generated (?:code|file|on|by|from)|\bgenerated (?:automatically|by|from|with|using)\b"
    r"|\b(?:created|written|built|made) automatically|\bmachine[- ]made\b|\bmachine[- ]generated\b|\boutput, input was\b"
    r"|\b(?:code|file) written by \S+, the\b|\bautomatisch erzeugt|\berzeugt (?:aus|von|durch|mit)\b|\b(?:produit|généré) par\b|\bgenerado por\b",
    re.IGNORECASE,
)
_SLASHED, _HASHED = r"/\*.*?(?:\*/|\Z)|//[^\n]*", r"#[^\n]*"
_COMMENTS = {k: re.compile(v, re.DOTALL) for k, v in ((False, _SLASHED), (True, _HASHED), (None, f"{_SLASHED}|{_HASHED}"))}
#: Languages whose comments begin with #, and those that know both kinds.
_HASH, _BOTH = ("python", "ruby", "perl"), ("php", "")
_LINE_MARK = re.compile(r'^#line \d+ "[^"\n]+\.(?:y|l|yy|ll|g|lex|rl)"', re.MULTILINE)
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?|0[xX][0-9a-fA-F]+|\d[\w.]*')
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_WORD, _DIGITS = re.compile(r"[^\W\d_]+|\d+"), re.compile(r"\d+")

_LETTERS = {c: i for i, c in enumerate("\x03abcdefghijklmnopqrstuvwxyz0123456789_$")}
_SIZE = len(_LETTERS)
_CODE = np.full(128, 0, np.int64)
for _c, _i in _LETTERS.items():
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i


def _comments(language: str) -> re.Pattern:
    return _COMMENTS[None if language in _BOTH else language in _HASH]


def names_of(head: str, language: str) -> tuple[list[str], int]:
    """The distinct identifiers of a head, without its comments, strings and numbers, and the length of the head
    without its comments."""
    code = _comments(language).sub(" ", head)
    return list(dict.fromkeys(_NAME.findall(_LITERAL.sub(" ", code)))), len(code)


def _grams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each character of each name and its end: index of the trigram, and the name it belongs to."""
    text = np.frombuffer("".join(f"\x03\x03{n}\x03" for n in names).encode("ascii"), np.uint8)
    codes = _CODE[text]
    sizes = np.fromiter((len(n) + 1 for n in names), np.int64, len(names))
    owner = np.repeat(np.arange(len(names)), sizes)
    at = np.arange(len(owner)) + 2 * (owner + 1)
    return (codes[at - 2] * _SIZE + codes[at - 1]) * _SIZE + codes[at], owner


class NameModel:
    """Trigram probabilities of the names of one language, smoothed by bigrams and single characters."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(_SIZE, _SIZE, _SIZE)
        two = three.sum(0)
        self._three, self._two, self._one = counts, two.ravel(), two.sum(0)
        self._pairs, self._firsts = three.sum(2).ravel(), two.sum(1)
        self.total = int(self._one.sum())
        p = (self._one + 0.5) / (self.total + 0.5 * _SIZE)
        p = (two + 5 * p) / (self._firsts[:, None] + 5)
        p = (three + 5 * p[None]) / (three.sum(2, keepdims=True) + 5)
        self._cost = -np.log(p).ravel()

    def cost(self, grams: np.ndarray) -> np.ndarray:
        return self._cost[grams]

    def cost_by_others(self, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The cost of grams that are in the counts, by the counts without those of their owner (0, 1, ... in order)."""
        sizes = np.bincount(owner)
        _, back, own = np.unique(owner * _SIZE**3 + grams, return_inverse=True, return_counts=True)

        def others(counts: np.ndarray, index: np.ndarray) -> np.ndarray:
            at = owner * len(counts) + index
            return counts[index] - np.bincount(at, minlength=len(sizes) * len(counts))[at]

        before = grams // _SIZE
        p = (others(self._one, grams % _SIZE) + 0.5) / (self.total - sizes[owner] + 0.5 * _SIZE)
        p = (others(self._two, grams % _SIZE**2) + 5 * p) / (others(self._firsts, before % _SIZE) + 5)
        p = (self._three[grams] - own[back] + 5 * p) / (others(self._pairs, before) + 5)
        return -np.log(p)


def comment_words(comment: str) -> list[int]:
    """Slots of the distinct words and pairs of words of a comment, numbers being alike."""
    words = ["0" if w.isdigit() else w for w in _WORD.findall(comment.lower())]
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % COMMENT_SLOTS for x in (*words, *map(" ".join, zip(words, words[1:])))})


def follows_template(names: list[str]) -> bool:
    return len(names) >= TEMPLATE_NAMES and 1 - len({_DIGITS.sub("0", n) for n in names}) / len(names) >= TEMPLATE


def entropies(names: list[list[str]], languages: list[str], counted: list[bool], models: dict[str, NameModel]) -> np.ndarray:
    """Cross-entropy per character of the names of each head, 0 without any; those of a head that is itself counted in the
    models are measured by all other heads."""
    out = np.zeros(len(names))
    groups: dict[tuple[str, bool], list[int]] = {}
    for i, (own, language, c) in enumerate(zip(names, languages, counted)):
        if own:
            groups.setdefault((language if language in models else "", c), []).append(i)
    for (language, c), heads in groups.items():
        while heads:
            size = np.cumsum([len(names[i]) for i in heads[:HEADS_AT_ONCE]])
            size = max(1, int(np.searchsorted(size, NAMES_AT_ONCE, "right")))
            part, heads = heads[:size], heads[size:]
            grams = _grams([n for i in part for n in names[i]])[0]
            sizes = np.array([sum(map(len, names[i])) + len(names[i]) for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            cost = models[language].cost_by_others(grams, owner) if c else models[language].cost(grams)
            out[part] = np.bincount(owner, cost) / sizes
    return out


class Limits:
    """Models and limits fitted on clean heads; bounded by the languages."""

    def __init__(self, models: dict[str, NameModel], mangled: dict[str, float], poor: dict[str, float], comments: np.ndarray):
        self.models, self.mangled, self.poor, self.comments = models, mangled, poor, comments

    def speaks_of_a_tool(self, head: str, language: str) -> bool:
        return _like_a_tools(_comments(language).findall(head), self.comments)


def _like_a_tools(comments: list[str], odds: np.ndarray) -> bool:
    return any(odds[slots].sum() > COMMENT_MARGIN * len(slots) ** 0.5 for slots in map(comment_words, comments) if slots)


def _by_tool(head: str, comments: list[str]) -> bool:
    return any(map(OPENINGS.search, comments)) or bool(_LINE_MARK.search(head))


def _plain(head: str) -> bool:
    """Whether a head without a sign of a tool in its comments may serve as clean for training: many short lines."""
    return "\n" in head and max(map(len, head.split("\n"))) <= 160


def _counted(heads: DataFrame) -> tuple[dict[str, NameModel], np.ndarray]:
    """Models of the names in the clean heads (language, head, tool, counted), and the log odds of the words of comments.

    Counts are made per worker and merged; languages are those of LANGUAGES, so what reaches the driver is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        spoken = np.zeros((2, COMMENT_SLOTS + 1), np.int64)
        for batch in batches:
            clean: dict[str, list[str]] = {}
            for language, head, tool, counted in zip(*[c.to_pylist() for c in batch.columns]):
                if not counted:
                    continue
                comments = _comments(language).findall(head)
                for slots in map(comment_words, comments):
                    if slots:
                        spoken[int(tool), slots] += 1
                        spoken[int(tool), COMMENT_SLOTS] += 1
                names, size = names_of(head, language)
                if names and _plain(head) and not _by_tool(head, comments):
                    sums.setdefault(language, np.zeros(_SIZE**3 + 1, np.int64))[-1] += size >= SHORT
                    clean.setdefault(language, []).extend(names)
                    if len(clean[language]) >= NAMES_AT_ONCE:
                        sums[language] += np.bincount(_grams(clean.pop(language))[0], minlength=_SIZE**3 + 1)
            for language, names in clean.items():
                sums[language] += np.bincount(_grams(names)[0], minlength=_SIZE**3 + 1)
        for language, c in [*sums.items(), ("//0", spoken[0]), ("//1", spoken[1])]:
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["language", "gram", "n"])

    rows = heads.select("language", "head", "tool", "counted").mapInArrow(count, "language string, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {"": np.zeros(_SIZE**3 + 1, np.int64)}
    spoken = np.zeros((2, COMMENT_SLOTS + 1))
    for r in rows:
        if r["language"].startswith("//"):
            spoken[int(r["language"][2:]), r["gram"]] += r["n"]
            continue
        if r["language"]:
            counts.setdefault(r["language"], np.zeros(_SIZE**3 + 1, np.int64))[r["gram"]] += r["n"]
        counts[""][r["gram"]] += r["n"]
    odds = np.log((spoken[:, :-1] + 0.5) / (spoken[:, -1:] + 1.0))
    comments = np.where(spoken[:, :-1].sum(0) >= 3, odds[1] - odds[0], 0.0) if spoken[1, -1] else np.zeros(COMMENT_SLOTS)
    # Words no tool has said would otherwise speak for one where its comments are few.
    comments = np.where(spoken[1, :-1] > 0, comments, np.minimum(comments, 0.0))
    return {language: NameModel(c[:-1]) for language, c in counts.items() if c[-1] >= LEAST_HEADS or not language}, comments


def _measured(heads: DataFrame, models: dict[str, NameModel], odds: np.ndarray) -> DataFrame:
    """(key, language, entropy, density, clean, told) of each head: cross-entropy of its names, distinct names per 100
    characters of code (infinite below SHORT), whether it is clean for training, and whether it shows a tool."""
    shared = heads.sparkSession.sparkContext.broadcast((models, odds))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, odds = shared.value
        for batch in batches:
            languages, heads, counted = (c.to_pylist() for c in batch.columns[1:])
            names, density, clean, told = [], [], [], []
            for language, head in zip(languages, heads):
                comments = _comments(language).findall(head)
                own, size = names_of(head, language)
                by_tool = _by_tool(head, comments)
                names.append(own)
                density.append(100 * len(own) / size if size >= SHORT else np.inf)
                clean.append(_plain(head) and not by_tool)
                told.append(by_tool or _like_a_tools(comments, odds) or follows_template(own))
            entropy = entropies(names, languages, [a and b for a, b in zip(counted, clean)], models)
            columns = [batch.column(0), batch.column(1), pa.array(entropy), pa.array(density, pa.float64()), pa.array(clean, pa.bool_()), pa.array(told, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "language", "entropy", "density", "clean", "told"])

    schema = f"key {heads.schema['key'].dataType.simpleString()}, language string, entropy double, density double, clean boolean, told boolean"
    return cut(heads.select("key", "language", "head", "counted").mapInArrow(measure, schema))


def _fitted(heads: DataFrame, most: int | None) -> tuple[Limits, DataFrame]:
    """The limits, and the measures they come from."""
    counted = F.lit(True) if most is None else F.pmod(F.xxhash64("key"), F.lit(max(heads.count(), 1))) < most
    heads = heads.withColumn("counted", counted)
    models, comments = _counted(heads)
    measured = _measured(heads, models, comments)
    clean = measured.where("clean and entropy > 0 and density < 1000").withColumn("language", F.explode(F.array_distinct(F.array("language", F.lit("")))))
    sums = clean.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.avg("entropy").alias("e"), F.stddev_pop("entropy").alias("s"), F.avg("density").alias("d")).collect()
    mangled, poor = {"": np.inf}, {"": 0.0}
    for r in sums:
        if r["n"] >= LEAST_HEADS or r["language"] == "":
            mangled[r["language"]] = r["e"] + DEVIATIONS * max(r["s"], 0.02)
            poor[r["language"]] = POOR * r["d"]
    return Limits(models, mangled, poor, comments), measured


def fit(heads: DataFrame, most: int | None = None) -> Limits:
    """Fits models and limits on all heads (key, language, head, tool), whatever their number. ``tool`` says that a file of
    the content bears a tool's name or directory: the words of the comments in such files are held against those of all others.

    No head is kept from the counts for the limits; each clean one is measured by the counts of all others. The model of all
    languages together, under the empty name, stands in for those with fewer than LEAST_HEADS. ``most`` is for trials and bounds
    the heads that are counted, not those measured; no query sets it."""
    return _fitted(heads, most)[0]


def head_kinds(heads: DataFrame) -> DataFrame:
    """(key, kind) of the heads (key, language, head, tool) that are generated, minified or data by their text."""
    limits, measured = _fitted(heads, None)

    def own(by_language: dict[str, float]) -> Column:
        table = F.create_map(*[F.lit(x) for kv in by_language.items() for x in (kv[0], float(kv[1]))])
        return F.coalesce(table[F.col("language")], F.lit(float(by_language[""])))

    kind = F.when(F.col("told"), F.lit("generated")).when(F.col("density") < own(limits.poor), F.lit("data")).when(F.col("entropy") > own(limits.mangled), F.lit("minified"))
    return measured.select("key", kind.alias("kind")).where("kind is not null")


def _language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[extension], F.lit(""))


def _by_tools_name(path: Column, name: Column) -> Column:
    """Whether a file bears a tool's name or lies in a tool's directory."""
    directories = F.transform(F.split(path, "/"), lambda x: F.lower(x))
    held = F.arrays_overlap(F.slice(directories, 1, F.greatest(F.size(directories) - 1, F.lit(0))), F.array(*[F.lit(x) for x in TOOL_DIRECTORIES]))
    return F.coalesce(held, F.lit(False)) | F.coalesce(F.when(path.isNull(), name).otherwise(F.element_at(F.split(path, "/"), -1)).rlike(TOOL_NAMES), F.lit(False))


def _bare(component: Column) -> Column:
    """A directory name without the version behind it."""
    return F.regexp_replace(component, r"[-_]v?\d+(?:\.\d+)*(?:[-+~.]?(?:rc\d*|b|dfsg\d*|orig))*$", "")


def not_handwritten(files: DataFrame, heads: DataFrame) -> DataFrame:
    """(row_id, kind) of the files that are not hand-written source of their own package.

    ``files`` has row_id, package, version, pathname, filename, key (of the content) and thirdparty; ``heads`` key and head,
    one row per key. kind is vendored, generated, minified or data, in this order where several hold. A null path or
    key, an empty head or one that is not there leaves the other signs; a thirdparty mark that is true is believed,
    one that is false is not; a package that is null counts as the one its first directory names together with the
    version. Rows of one key are judged alike but for what depends on their path; a null path is made up for by the file
    name, and by the other rows of the package and key. Extra columns have no influence.
    """
    own = files.select("row_id", "package", "version", "pathname", "filename", "key", "thirdparty")
    language = own.where("key is not null").groupBy("key").agg(F.min(_language(F.col("pathname"))).alias("language"), F.max(_by_tools_name(F.col("pathname"), F.col("filename"))).alias("tool"))
    texts = heads.select("key", "head").where("key is not null and head is not null and head != ''")
    known = cut(texts.join(language, "key", "left").select("key", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("tool", F.lit(False)).alias("tool"), "head"))
    by_head = head_kinds(known).withColumnRenamed("kind", "by_head")

    path = F.regexp_replace(F.coalesce("pathname", F.lit("")), r"^(?:\./)+", "")
    parts = F.split(path, "/")
    directories = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rooted = (F.size("d") > 0) & F.endswith(F.element_at("d", 1), F.concat(F.lit("-"), F.col("version")))
    root = F.when(rooted, F.expr("substring(d[0], 1, length(d[0]) - length(version) - 1)"))
    own = own.withColumn("d", directories).withColumn("name", F.when(F.col("pathname").isNull(), F.col("filename")).otherwise(F.element_at(parts, -1)))
    own = own.withColumn("own", F.coalesce("package", root)).withColumn("d", F.when(F.coalesce(rooted, F.lit(False)), F.expr("slice(d, 2, greatest(size(d) - 1, 0))")).otherwise(F.col("d")))
    low = F.transform("d", lambda x: F.lower(x))
    by_path = (
        F.when(F.arrays_overlap(low, F.array(*[F.lit(x) for x in TOOL_DIRECTORIES])) | F.col("name").rlike(TOOL_NAMES), F.lit("generated"))
        .when(F.col("name").rlike(SHRUNK_NAMES), F.lit("minified"))
    )
    own = own.withColumn("by_path", by_path).withColumn("low", low).withColumn("bare", F.transform("d", _bare))
    own = own.withColumn("believed", F.coalesce("thirdparty", F.lit(False)))
    # Below a directory for copies: is there a further one that is not the package's own?
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    below = f"exists(sequence(1, greatest(size(d), 1)), i -> i < size(d) and array_contains(array({quote(COPIES)}), low[i - 1]) and exists(slice(bare, i + 1, size(d)), x -> not array_contains(array({quote(PASSED)}), x) and not x <=> own))"
    own = own.withColumn("copied", F.expr(below))
    # All that the path says, written once: it is read several times, and costs more than the reading.
    maybe = F.expr(f"exists(low, x -> array_contains(array({quote(MAYBE_COPIES)}), x))")
    others = F.when(~F.col("believed") & ~F.col("copied"), F.filter(F.array_distinct("bare"), lambda x: ~x.eqNullSafe(F.col("own"))))
    own = cut(own.select("row_id", "package", "key", F.col("pathname").isNull().alias("pathless"), "by_path", "believed", "copied", maybe.alias("maybe"), others.alias("others")))
    # Directories named after another package, as far as they matter.
    open_ = own.select("row_id", "key", "maybe", F.explode("others").alias("other"))
    packages = files.select(F.col("package").alias("other")).where("package is not null").distinct()
    named = open_.join(packages, "other")
    held = files.select("key", F.col("package").alias("other")).where("key is not null and package is not null").distinct()
    foreign = named.where("not maybe").join(held, ["key", "other"], "left_semi").select("row_id").unionByName(named.where("maybe").select("row_id"))
    foreign = foreign.distinct().withColumn("foreign", F.lit(True))

    # A row without a path: does the package list its content elsewhere as a copy?
    copies = own.where("(believed or copied) and package is not null and key is not null").select("package", "key").distinct()
    foreign = foreign.unionByName(own.where("pathless").join(copies, ["package", "key"], "left_semi").select("row_id", F.lit(True).alias("foreign")))

    # What a tool's name says of a content holds for all its rows.
    by_content = by_head.unionByName(own.where("key is not null and by_path is not null").select("key", F.col("by_path").alias("by_head")))
    by_content = by_content.groupBy("key").agg(F.min("by_head").alias("by_head"))
    hot, fanned = hot_keys(own, "key"), fan(files)
    rows = salted(own, "key", hot, F.col("row_id"), fanned).join(replicated(by_content, "key", hot, fanned), ["key", SALT], "left").join(foreign, "row_id", "left")
    vendored = F.col("believed") | F.col("copied") | F.coalesce("foreign", F.lit(False))
    kind = F.when(vendored, F.lit("vendored")).otherwise(F.coalesce("by_path", "by_head"))
    return rows.select("row_id", kind.alias("kind")).where("kind is not null")
