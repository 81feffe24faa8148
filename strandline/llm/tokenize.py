"""Encoding of texts with a public byte-level BPE tokenizer, and their sizes in ids.

Method: a lexicon of the most frequent words of the collection is compiled into a minimal acyclic transducer whose
outputs lead to the words' ids, sent to the executors as a file and mapped into memory there. A text is split by the
tokenizer's pattern; words found in the lexicon give their ids, unseen words are merged exactly by the tokenizer's
ranks. Which words are in the lexicon has no influence on the result.

Defined cases: the ids of an empty and of a null text are the empty list; strings of special tokens are ordinary
text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.transducer import Transducer, compile_words
from strandline.session import cut, scratch

#: Folder of the public vocabularies; each function takes another as a parameter.
VOCABULARIES = os.environ.get("STRANDLINE_VOCABULARIES", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space as the tokenizer's pattern means it (the Unicode property).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Words in the lexicon at most; it takes about 40 bytes a word.
LEXICON_WORDS = 65_536
_MEMO, _COUNTED = 400_000, 200_000
#: Characters whose words are held at a time.
PART = 1 << 20


class WordEncoder:
    """Ids of single words by the merge ranks of a vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, word: bytes) -> list[int]:
        return self._core._encode_single_piece(word)


def _ranges(finds, top: int) -> str:
    """The characters below ``top`` for which ``finds`` holds, as the inside of a character class."""
    held = [finds(chr(i)) is not None for i in range(top)] + [False]
    out, start = [], None
    for i, ok in enumerate(held):
        if ok and start is None:
            start = i
        elif not ok and start is not None:
            out.append(re.escape(chr(start)) + (f"-{re.escape(chr(i - 1))}" if i - 1 > start else ""))
            start = None
    return "".join(out)


class Splitter:
    """Splits texts into words by the tokenizer's pattern.

    The standard library's engine is twice as fast as the one that knows Unicode properties, but for large classes of
    characters; so texts of ASCII and of characters below U+2100 get patterns of their own, made from the properties."""

    def __init__(self):
        import regex

        self._all = regex.compile(PATTERN)
        self._beyond = re.compile("[\u2100-\U0010ffff]").search
        self._ascii, self._low = (self._narrow(regex, top) for top in (128, 0x2100))

    @staticmethod
    def _narrow(regex, top: int) -> re.Pattern:
        letter, number, space = (_ranges(regex.compile(p).fullmatch, top) for p in (r"\p{L}", r"\p{N}", f"[{_SPACE}]"))
        return re.compile(rf" ?[{letter}]++|'(?:[sdmt]|ll|ve|re)| ?[{number}]++| ?[^{space}{number}{letter}]++|[{space}]+(?![^{space}])|[{space}]+")

    def _for(self, text: str):
        return self._ascii if text.isascii() else self._all if self._beyond(text) else self._low

    def words(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def each(self, text: str) -> Iterator[str]:
        """The words one by one, for texts too long to hold all their words."""
        return (m.group() for m in self._for(text).finditer(text))


def frequent_words(texts: DataFrame, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of the string column ``text`` over all rows: all that reach the least count, in steps
    of an eighth of a power of two, which no more than ``limit`` words reach.

    Counts are over the whole collection, formed per worker and merged; at most ``limit`` words reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = Splitter(), Counter()

        def held():
            return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(split.words(text) if len(text) <= PART else split.each(text))
            if len(counts) > _COUNTED:
                yield held()
                counts = Counter()
        yield held()

    found = cut(texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # The least count that at most ``limit`` words reach, by eighths of powers of two.
    level = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in found.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        held += r["words"]
        if held > limit:
            break
        least = r["level"]
    return [] if least is None else [bytes(r["word"]) for r in found.where(level >= least).select("word").collect()]


def _published(spark: SparkSession, data: bytes, kind: str) -> str:
    """Sends a file to all executors through the shared folder, from which one that comes later gets it too; returns
    its name there, which is never used twice."""
    sc, path = spark.sparkContext, scratch(spark, kind)
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    sc.addFile(target.toString())
    return path.rsplit("/", 1)[1]


def publish_lexicon(texts: DataFrame, vocabularies: str = VOCABULARIES, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> tuple[str, str]:
    """Compiles the lexicon and sends it and the vocabulary to all executors; returns their file names there."""
    path, spark = os.path.join(vocabularies, vocabulary), texts.sparkSession
    encoder = WordEncoder(path)
    lexicon = compile_words((w, encoder.ids(w)) for w in frequent_words(texts, words))
    with open(path, "rb") as f:
        return _published(spark, lexicon, "lexicon"), _published(spark, f.read(), "vocabulary")


class _Numbers(dict):
    """Numbers words in the order in which they are met; ``new`` has those not yet learned."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class TextEncoder:
    """Encodes batches of texts in a worker; words already met are kept up to a bound."""

    def __init__(self, lexicon: str, vocabulary: str):
        self._split = Splitter()
        self._lexicon = Transducer(lexicon)
        self._words = WordEncoder(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self._memo = _Numbers()
        self._lengths, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = self._lexicon.index(raw)
        ends, ids = self._lexicon.ends, self._lexicon.ids
        own = [ids[ends[k] : ends[k + 1]] if k >= 0 else np.asarray(self._words.ids(w), np.int32) for k, w in zip(found.tolist(), raw)]
        self._lengths = np.concatenate([self._lengths, np.fromiter(map(len, own), np.int64, len(own))])
        self._flat = np.concatenate([self._flat, *own])

    def encode(self, texts: list[str | None], only_sizes: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(sizes in ids, all ids one after the other or nothing). Texts are taken in parts of about PART characters,
        and a longer one word by word, so that only a bounded number of words is held at a time."""
        sizes, flat, at = [], [], 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= PART):
                chars += len(texts[to] or "")
                to += 1
            n, ids = self._part(texts[at:to], only_sizes)
            sizes.append(n)
            flat.append(ids)
            at = to
        return (np.concatenate(sizes), np.concatenate(flat)) if sizes else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _part(self, texts: list[str | None], only_sizes: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(self._memo) > _MEMO:
            self._clear()
        memo = self._memo
        if len(texts) == 1 and texts[0] and len(texts[0]) > PART:
            at = np.fromiter((memo[w] for w in self._split.each(texts[0])), np.int64)
            counts = [len(at)]
        else:
            split = [self._split.words(t) if t else [] for t in texts]
            counts = list(map(len, split))
            at = np.fromiter((memo[w] for x in split for w in x), np.int64, sum(counts))
        if memo.new:
            self._learn(memo.new)
            memo.new = []
        size = self._lengths[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        borders = np.cumsum([0, *counts])
        sizes = upto[borders[1:]] - upto[borders[:-1]]
        if only_sizes:
            return sizes, self._flat[:0]
        starts = (np.cumsum(self._lengths) - self._lengths)[at]
        return sizes, self._flat[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])]


_encoders: dict[tuple[str, str], TextEncoder] = {}


def _encoder(lexicon: str, vocabulary: str) -> TextEncoder:
    if (lexicon, vocabulary) not in _encoders:
        _encoders.clear()
        _encoders[lexicon, vocabulary] = TextEncoder(SparkFiles.get(lexicon), SparkFiles.get(vocabulary))
    return _encoders[lexicon, vocabulary]


def encode_texts(df: DataFrame, text: str, *, vocabularies: str = VOCABULARIES, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> DataFrame:
    """``df`` without ``text`` and with ``ids``, the list of ids of each text. No shuffle; rows stay where they are.

    Another column of the name ``ids`` is replaced."""
    return _encoded(df, text, vocabularies, vocabulary, words, sizes=False)


def text_sizes(df: DataFrame, text: str, *, vocabularies: str = VOCABULARIES, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> DataFrame:
    """``df`` without ``text`` and with ``n_ids``, the number of ids of each text, 0 for an empty or null one. Another
    column of the name ``n_ids`` is replaced."""
    return _encoded(df, text, vocabularies, vocabulary, words, sizes=True)


def _encoded(df: DataFrame, text: str, vocabularies: str, vocabulary: str, words: int, *, sizes: bool) -> DataFrame:
    names = publish_lexicon(df.select(F.col(text).alias("text")), vocabularies, vocabulary, words)
    result = T.StructField("n_ids", T.LongType()) if sizes else T.StructField("ids", T.ArrayType(T.IntegerType()))
    kept = [c for c in df.columns if c not in (text, result.name)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*names)
        for batch in batches:
            n, ids = encoder.encode(batch.column(0).to_pylist(), only_sizes=sizes)
            if sizes:
                own = pa.array(n, pa.int64())
            else:
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], own], [*kept, result.name])

    schema = T.StructType([*[df.schema[c] for c in kept], result])
    return df.select(text, *kept).mapInArrow(encode, schema)
