"""Audits of text: markers, addresses, smells and calls."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import line_at

EMAIL = r"([A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
URL = r"((?:https?|ftp)://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~%/?&=#-]*)?)"
#: Words of one automaton, which is sent to every worker and built there once; more words take further passes.
WORDS = 200_000


def shell_invocation(line: Column) -> Column:
    """A line that seems to call a program with what it was given."""
    return line.rlike("/s?bin") & (F.contains(line, F.lit("%s")) | F.contains(line, F.lit("*")))


def copyright_line(line: Column) -> Column:
    low = F.lower(line)
    return F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(line, F.lit("©"))


def emails(text: Column) -> Column:
    """Addresses in a text, without example domains and malformed ones."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(1)))
    return F.filter(found, lambda x: ~F.contains(x, F.lit("..")) & ~F.startswith(x, F.lit(".")) & ~F.lower(x).rlike(r"@example\."))


def urls(text: Column, longest: int = 1000) -> Column:
    """URLs in a text, without local hosts, hosts without a dot and overlong ones."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(1)))
    local = r"^[a-z]+://(?:127\.0\.0\.1|192\.168\.|10\.|\[?::1|[^./]+(?:[:/]|$))"
    return F.filter(found, lambda x: ~x.rlike(local) & (F.length(x) <= longest))


def marked(df: DataFrame, key: Sequence[str], text: str, markers: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key..., marker): the markers of which a text contains one of the words. The table of markers is fixed and
    becomes one expression, so each text is read once."""
    hits = [F.when(F.greatest(*[F.contains(F.col(text), F.lit(w)).cast("int") for w in words], F.lit(0)) == 1, F.lit(m)) for m, words in markers.items()]
    return df.where(F.col(text).isNotNull()).select(*key, F.explode(F.array_compact(F.array(*hits))).alias("marker")).distinct()


def calls(df: DataFrame, key: Sequence[str], text: str, names: Sequence[str]) -> DataFrame:
    """(key..., name, linenumber): calls of the named functions in source text."""
    lines = F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")
    pattern = r"\b(" + "|".join(names) + r")\s*\("
    found = df.where(F.col(text).isNotNull()).select(*key, lines).where(F.col("line").rlike(pattern))
    return found.select(*key, F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("name"), (F.col("at") + 1).alias("linenumber"))


_automata: dict = {}


def _automaton(token: str, words):
    """The automaton of a broadcast list, built once by each worker process."""
    if token not in _automata:
        import ahocorasick

        _automata.clear()
        _automata[token] = own = ahocorasick.Automaton()
        for w in words.value:
            own.add_word(w, w)
        own.make_automaton()
    return _automata[token]


def containing(df: DataFrame, key: str, text: str, words: DataFrame, *, most: int = WORDS) -> DataFrame:
    """(key, word): the words that occur anywhere in a text, of the string column word of ``words``. Empty and null words
    are none. All words are searched in one pass over the texts, in one per ``most`` words where there are more."""
    own = words.select("word").where("word is not null and word != ''").distinct()
    parts = max(1, -(-own.count() // most))
    part = F.pmod(F.xxhash64("word"), F.lit(parts))
    texts = df.select(key, text).where(F.col(text).isNotNull())
    found = [_searched(texts, key, text, sorted(r[0] for r in own.where(part == k).collect())) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _searched(texts: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    sent, token = texts.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(token, sent) if sent.value else None
        for batch in batches:
            keys, found = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = {w for _, w in automaton.iter(t)} if t and automaton else set()
                keys += [k] * len(hits)
                found += sorted(hits)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.string())], [key, "word"])

    return texts.select(key, text).mapInArrow(search, f"`{key}` {dict(texts.dtypes)[key]}, word string")


def first_places(text: Column, word: str) -> Column:
    """The line on which a word first occurs, null if it does not."""
    at = F.instr(text, word)
    return F.when(at > 0, line_at(text, at))


def log_in_hits(passwords: DataFrame, known: DataFrame) -> DataFrame:
    """(login, hash, password) of shadow entries (login, hash) whose hash is known (hash, password)."""
    return passwords.dropna().join(known.dropna().dropDuplicates(["hash"]), "hash").select("login", "hash", "password")


def crc_matches(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Encrypted archive entries (entry, crc) whose plain content is known (crc, key); a crc of 0 says nothing."""
    return entries.where("crc != 0").join(known.select("crc", "key").distinct(), "crc")
