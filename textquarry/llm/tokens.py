"""Token counts under an existing byte-level BPE vocabulary, and token budgets by slice of the corpus.

Method: the vocabulary is compiled into an Aho-Corasick automaton. Reading a piece of text from left to right, the last
token of every prefix is the one token ending there that is compatible with the last token of the prefix before it;
compatibility is decided by undoing merges of the two tokens at their seam. So exact encodings are counted in linear
time, without a list of identifiers. Counts then feed aggregate cubes.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textquarry.llm.language import language_of_label
from textquarry.runtime import map_texts

#: Where vocabulary files lie unless a path is given; never part of this repository.
VOCABULARY = os.environ.get("TEXTQUARRY_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How byte-level BPE vocabularies of this family cut text into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Pieces whose counts a task remembers.
REMEMBERED = 500_000


class Vocabulary:
    """Merge tables of a byte-level BPE: tokens by rank, the two parts of each, and which pairs merge."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.digest = hashlib.sha256(b"\0".join(tokens)).hexdigest()
        rank = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = rank.get(t[:k], i), rank.get(t[k:], i)
                if a < i and b < i and self.compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    break

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
        if [i for i, _ in pairs] != list(range(len(pairs))):
            raise ValueError(f"ranks of {path} are not 0, 1, 2, ...")
        return cls([t for _, t in pairs])

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens side by side: no merge across their seam comes before they are whole."""
        merged, left, right = self.merged, self.left, self.right
        limit = len(self.tokens)
        while True:
            if (c := merged.get((a, b))) is not None and c < limit:
                return False
            if a > b:  # a was made last: undo it, and look at its right part
                limit = a
                a = right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        return True


class Counter:
    """Counts tokens of texts; remembers pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary, pieces: str = PIECES):
        self._v = vocabulary
        self._find = regex.compile(pieces).findall
        self._machine = ahocorasick.Automaton()
        for i, t in enumerate(vocabulary.tokens):
            self._machine.add_word(t.decode("latin-1"), (i, len(t)))  # bytes as characters
        self._machine.make_automaton()
        counter = self

        class Seen(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                n = counter.count_piece(piece)
                if len(piece) <= 64:
                    self[piece] = n
                return n

        self._seen = Seen()

    def count_piece(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, count = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        compatible = self._v.compatible
        for end, (token, n) in self._machine.iter(raw):
            end += 1
            if last[end] < 0:
                start = end - n
                if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                    last[end], count[end] = token, count[start] + 1
        return count[-1]

    def count(self, text: str | None) -> int | None:
        """Tokens of a text; null for null, 0 for an empty one."""
        if text is None:
            return None
        return sum(map(self._seen.__getitem__, self._find(text)))


_OUT = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id and the exact number of tokens; null for null text. Repeated rows repeat, other columns are ignored.

    The vocabulary is read and compiled once, on the driver; its tables, of a size that the file fixes, go to the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def make():
        c = _counter(shared)

        def f(ids: list, texts: list) -> dict:
            return {"doc_id": ids, "tokens": [c.count(t) for t in texts]}

        return f

    return map_texts(df, id_col, text_col, _OUT, "doc_id long, tokens long", make)


_COUNTERS: dict[str, Counter] = {}


def _counter(shared) -> Counter:
    """One automaton for all tasks of a Python worker, known by what its vocabulary holds."""
    key = shared.value.digest
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(shared.value)
    return _COUNTERS[key]


def tidy(c: Column) -> Column:
    """A slice's name in lower case without outer blanks; null where nothing is left."""
    t = F.regexp_replace(F.lower(c), r"^[\s  ​﻿.]+|[\s  ​﻿]+$", "")
    return F.when(t.isin("", "none", "null", "unknown", "n/a"), F.lit(None)).otherwise(t)


def tidy_topic(c: Column) -> Column:
    """tidy, with plurals brought to the singular ("reviews" and "review" are one slice; "news" is no plural)."""
    t = tidy(c)
    return F.when(t.rlike("[^s]s$") & (t != "news"), F.regexp_replace(t, "s$", "")).otherwise(t)


def tidy_language(c: Column) -> Column:
    """The two-letter code of a language label, whatever its notation; other labels in lower case."""
    t = tidy(c)
    return F.coalesce(language_of_label(c), F.when(t.isin("xx", "und"), F.lit(None)).otherwise(t))


def budget(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The cube of docs, chars and tokens by source, lang, topic and format, spellings of one slice brought together.

    level names the columns that a row is broken down by ("" for the total); a null in such a column is the slice
    without a name. Texts are counted one by one, slices are summed before the cube spreads them, so it is small.
    Null texts count as documents without tokens; an empty table gives an empty cube.
    """
    slices = {"source": tidy(F.col("source")), "lang": tidy_language(F.col("lang")), "topic": tidy_topic(F.col("topic")), "format": tidy(F.col("format"))}
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    base = df.select(*(c.alias(n) for n, c in slices.items()), F.col("text").alias("_text"))
    count = count_udf(shared)
    names = list(slices)
    base = base.select(*names, F.length("_text").alias("chars"), count("_text").alias("tokens"))
    small = base.groupBy(*names).agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    cube = small.cube(*names).agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("_g"))
    level = F.concat_ws(",", *(F.when(F.col("_g").bitwiseAND(1 << (len(names) - 1 - i)) == 0, F.lit(n)) for i, n in enumerate(names)))
    return cube.select(level.alias("level"), *names, F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def count_udf(shared) -> Callable[[str], Column]:
    """A vectorised function from texts to their tokens."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        c = _counter(shared)
        return pd.Series([c.count(t) for t in texts], dtype="Int64")

    return count
