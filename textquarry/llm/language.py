"""The language of each document and of each segment of mixed documents, with a confidence.

Method: hierarchical discrimination. Linear classifiers on the n-grams of words first tell the family; within it
one-versus-one linear support vector machines separate the related languages. The hierarchy is soft: how firmly the
family is known is added to the scores of its languages, so that a sure pair may outweigh an unsure family. They are trained here, on a bounded,
seeded sample of rows that carry a language label (TRAIN_DOCUMENTS for each language) and on the function words.
Sentences are judged one by one, so a mixed document falls into segments.
"""

from __future__ import annotations

import re
import zlib
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.encoding import repair
from textquarry.llm.shape import COMMON, kind_of
from textquarry.runtime import map_texts

#: Families of the languages told apart.
FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt"), "slavic": ("ru",)}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))
#: Other notations of the languages, besides region suffixes and letter case.
NOTATIONS = {
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "duits"),
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglese", "inglês", "engels"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "flemish"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais"),
    "ru": ("ru", "rus", "russian", "русский", "russisch", "russe", "ruso"),
}
#: Documents of each language, chosen by seeded hash, that the classifiers are trained on at most.
TRAIN_DOCUMENTS = 250
#: Sentences of each language, drawn from these and the function words, and words of each, that they are trained on at most.
TRAIN_SENTENCES, TRAIN_WORDS = 1500, 30
SLOTS = 16384
PAIRS = tuple(p for f in FAMILIES.values() for p in combinations(f, 2))
#: A language counts in a document from this share of its words.
LEAST_SHARE = 0.2

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_DROP = re.compile(r"```.*?(?:```|$)|<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:amp;)?lt;/?[A-Za-z](?:[^<>&]|&(?!(?:amp;)?[lg]t;))*&(?:amp;)?gt;|&#?\w{2,31};|https?://\S+|\S+@\S+|\$\$.*?\$\$|\$(?![\s\d])[^$\n]+(?<!\s)\$(?!\w)|\\(?:begin|end)\{[^}]*\}|\\[A-Za-z]+\*?|\{\{[a-z]+\b|\{\|[^\n]*|\[\[[A-Z]\w+:", re.S)
_MARKED = re.compile(r"[<&`$\\\\{\[@]|://")
_ENDS = ("!", "?", "…", "\t", "|", "\r", ";", ". ", ".\n", '."', ".”")


def language_of_label(label: Column) -> Column:
    """The two-letter code that a label names, among LANGUAGES; null for all else."""
    plain = F.lower(F.trim(label))
    base = F.regexp_extract(plain, r"^([^\s\-_()]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        out = F.when(base.isin(*names), F.lit(code)).otherwise(out)
    return out


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, line or cell; markup, code, formulas and addresses are left out."""
    if _MARKED.search(text):
        text = _DROP.sub(" ", text)
    # a full stop ends a sentence before a blank or a closing quote; the other marks always do
    for end in _ENDS:
        if end in text:
            text = text.replace(end, "\n")
    find = _WORD.findall
    return [ws for piece in text.split("\n") if piece and (ws := find(piece))]


def slots(word: str) -> np.ndarray:
    """Hashed n-grams of a word: the word itself, and its parts of two to four letters with its ends marked."""
    w = f"<{word.lower()}>"
    grams = {w} | {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}
    return np.array([zlib.crc32(g.encode()) % SLOTS for g in grams], dtype=np.int64)


class LanguageModel:
    """Weights of the family classifiers and of the pairs; scores of words are sums over their n-grams."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias
        self._row: dict[str, int] = {}
        self._table = np.zeros((1024, weights.shape[1]), dtype=np.float32)
        self._size = np.zeros(1024, dtype=np.float32)

    def __reduce__(self):
        return LanguageModel, (self.weights, self.bias)

    def row(self, word: str) -> int:
        i = self._row.get(word)
        if i is None:
            if len(self._row) > 400_000:  # memory of a task stays bounded
                self._row.clear()
            i = len(self._row)
            if i >= len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
                self._size = np.concatenate([self._size, np.zeros_like(self._size)])
            s = slots(word)
            self._table[i], self._size[i] = self.weights[s].sum(0), len(s)
            self._row[word] = i
        return i

    def scores(self, sents: list[list[str]]) -> np.ndarray:
        """Score of each sentence for each of LANGUAGES: that of its family, weighed by how firmly it is known, plus its mean margin in the pairs."""
        if not sents:
            return np.zeros((0, len(LANGUAGES)), dtype=np.float32)
        if len(self._row) + sum(map(len, sents)) > 400_000:
            self._row.clear()
        get = self._row.get
        rows = [get(w) for s in sents for w in s]
        if None in rows:
            row = self.row
            rows = [row(w) for s in sents for w in s]
        rows = np.array(rows)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sents])[:-1]])
        raw = np.add.reduceat(self._table[rows], at) / np.sqrt(np.add.reduceat(self._size[rows], at))[:, None] + self.bias
        names = list(FAMILIES)
        family = raw[:, : len(names)]
        best = family.argmax(1)
        two = np.partition(family, -2, axis=1)
        sure = np.minimum(2.0, 2.5 * (two[:, -1] - two[:, -2]))  # how firmly the family is known
        out = np.zeros((len(sents), len(LANGUAGES)), dtype=np.float32)
        for k, f in enumerate(names):
            for x in FAMILIES[f]:
                margin = np.zeros(len(sents), dtype=np.float32)
                for j, (a, b) in enumerate(PAIRS):
                    if x in (a, b):
                        margin += np.clip(raw[:, len(names) + j] * (1 if x == a else -1), -2, 2)
                out[:, LANGUAGES.index(x)] = np.clip(family[:, k], -2, 2) + margin / max(1, len(FAMILIES[f]) - 1) + sure * (best == k)
        return out


def train(examples: list[tuple[str, str]], steps: int = 2000, seed: int = 7) -> LanguageModel:
    """Linear SVMs by stochastic subgradients on (language, text); unknown languages are left out."""
    rng = np.random.default_rng(seed)
    rows, langs = [], []
    for code in LANGUAGES:
        own = [COMMON[code].split()[i : i + 8] for i in range(0, 48, 4)]
        for lang, text in examples:
            if lang == code:
                own += [s[:TRAIN_WORDS] for s in sentences(repair(text)[1]) if len(s) >= 3]
        own = [s for s in own if s]
        own += [s[a : a + int(rng.integers(2, 6))] for s in own for a in (int(rng.integers(0, max(1, len(s) - 2))),)]  # short pieces, as in lists
        pick = rng.permutation(len(own))[:TRAIN_SENTENCES]
        rows += [own[i] for i in pick]
        langs += [code] * len(pick)
    known = {w: slots(w) for w in {w for s in rows for w in s}}
    ids = [np.concatenate([known[w] for w in s]) for s in rows]
    langs = np.array(langs)
    goals = [np.where(np.isin(langs, FAMILIES[f]), 1, -1) for f in FAMILIES] + [np.where(langs == a, 1, np.where(langs == b, -1, 0)) for a, b in PAIRS]
    y = np.stack(goals, 1).astype(np.float32)
    w = np.zeros((SLOTS, y.shape[1]), dtype=np.float32)
    bias = np.zeros(y.shape[1], dtype=np.float32)
    total, total_bias = w.copy(), bias.copy()
    penalty = 1e-4
    size = {c: int((langs == c).sum()) for c in LANGUAGES}
    weight = np.array([1 / size[c] for c in langs])
    weight /= weight.sum()
    order = rng.choice(len(rows), (steps, 48), p=weight)
    for t in range(1, steps + 1):
        pick = order[t - 1]
        own = [ids[i] for i in pick]
        count = np.array([len(o) for o in own])
        flat = np.concatenate(own)
        scale = (1 / np.sqrt(count)).astype(np.float32)[:, None]
        margin = np.add.reduceat(w[flat], np.concatenate([[0], np.cumsum(count)[:-1]])) * scale + bias
        wrong = (y[pick] * margin < 1) * y[pick]
        rate = 0.5 / (1 + 0.01 * t)
        w *= 1 - rate * penalty
        np.add.at(w, flat, np.repeat(rate / 48 * scale * wrong, count, axis=0))
        bias += 0.1 * rate / 48 * wrong.sum(0)
        if t > steps // 3:
            total += w
            total_bias += bias
    n = steps - steps // 3
    return LanguageModel(total / n, total_bias / n)


def fit_model(df: DataFrame, text_col: str, label_col: str, seed: int = 7) -> LanguageModel:
    """Classifiers trained on TRAIN_DOCUMENTS different labelled texts of each language, or all where there are fewer, chosen by seeded hash.

    Copies of a text count once. Rows without a usable label are not read for this; with no labelled rows at all,
    function words alone teach.
    """
    named = df.select(F.col(text_col).alias("t"), language_of_label(F.col(label_col)).alias("c")).filter("c is not null and length(t) > 40")
    named = named.withColumn("h", F.xxhash64("t", F.lit(seed)))
    counts = {r.c: r.n for r in named.select("c", "h").distinct().groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row for each language
    keep = F.lit(0)
    drawn = TRAIN_DOCUMENTS + 6 * TRAIN_DOCUMENTS**0.5  # so many more that a draw by rate practically never falls short
    for c, n in counts.items():
        keep = F.when(F.col("c") == c, F.lit(min(1_000_000, int(1e6 * drawn / n) + 1))).otherwise(keep)
    some = named.filter(F.pmod("h", F.lit(1_000_000)) < keep)  # with copies, of which each task keeps one
    rank = F.row_number().over(Window.partitionBy("c").orderBy("h"))
    used = some.groupBy("c", "h").agg(F.first("t").alias("t")).withColumn("rank", rank).filter(F.col("rank") <= TRAIN_DOCUMENTS)
    return train([(r.c, r.t) for r in sorted(used.collect(), key=lambda r: (r.h, r.c))], seed=seed)


class Judged:
    """Sentences of a batch of texts: of which text, in which language, of how many words, how surely."""

    def __init__(self, of: np.ndarray, lang: np.ndarray, words: np.ndarray, confidence: np.ndarray, texts: int):
        self.of, self.lang, self.words, self.confidence = of, lang, words, confidence
        n = len(LANGUAGES)
        self.by = np.bincount(of * n + lang, weights=words, minlength=texts * n).reshape(texts, n)
        self.sure = np.bincount(of * n + lang, weights=words * confidence, minlength=texts * n).reshape(texts, n)
        self.total = self.by.sum(1)

    def shares(self, i: int) -> dict[str, tuple[float, float]]:
        """language -> (share of the words, mean confidence) of text i, where it is LEAST_SHARE or more."""
        total = self.total[i]
        return {LANGUAGES[k]: (float(self.by[i, k] / total), float(self.sure[i, k] / self.by[i, k])) for k in np.flatnonzero(self.by[i] >= LEAST_SHARE * total)} if total else {}


def judge(model: LanguageModel, texts: list[str | None]) -> Judged:
    """The sentences of each text; none for null, blank or wordless texts."""
    per = [sentences(t if t.isascii() else repair(t)[1]) if t and not t.isspace() else [] for t in texts]
    flat = [s for doc in per for s in doc]
    of = np.repeat(np.arange(len(texts)), [len(doc) for doc in per])
    k = np.array([len(s) for s in flat], dtype=np.int64)
    if not flat:
        return Judged(of, k, k, k.astype(float), len(texts))
    n = len(LANGUAGES)
    s = model.scores(flat)
    first = s.argmax(1)
    share = np.bincount(of * n + first, weights=k * np.where(k >= 4, 1.1, 0.1), minlength=len(texts) * n).reshape(-1, n)
    share = (share / np.maximum(share.sum(1, keepdims=True), 1e-9)).astype(np.float32)
    own = share[of]
    near = s + own * np.minimum(8.0, 30.0 / k).astype(np.float32)[:, None]  # what the whole document speaks weighs on its short sentences
    top = near.argmax(1)
    two = np.partition(near, -2, axis=1)
    margin = two[:, -1] - two[:, -2]
    lead = own.argmax(1)
    top = np.where((margin < 0.8) & (own[np.arange(len(k)), lead] > 0.55), lead, top)  # an unsure sentence goes with the rest
    return Judged(of, top, k, 1 / (1 + np.exp(-1.5 * margin)), len(texts))


_SHARES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64()), ("kind", pa.string())])


def document_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """A row for each language of a document with at least LEAST_SHARE of its words: doc_id, lang, share, confidence, kind.

    kind (of shape.kind_of) is given where ``label_col`` is named and the rows are cases: no usable label, a label that
    names none of them, or two and more languages; it is null for the rest. Null, blank and wordless texts give no row;
    repeated rows repeat; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # SLOTS x classifiers floats, whatever the corpus

    def make():
        m = shared.value

        def f(ids: list, texts: list) -> dict:
            out: dict[str, list] = {n: [] for n in _SHARES.names}
            labels = [None] * len(texts)
            if label_col:
                labels, texts = [t.split("\x1f", 1)[0] if t else None for t in texts], [t.split("\x1f", 1)[1] if t else None for t in texts]
            judged = judge(m, texts)
            for j, (i, text, label) in enumerate(zip(ids, texts, labels, strict=True)):
                found = judged.shares(j)
                if not found:
                    continue
                case = label_col and (len(found) > 1 or label not in found)
                kind = kind_of(text) if case and found else None
                for lang, (share, conf) in found.items():
                    for n, v in zip(_SHARES.names, (i, lang, share, conf, kind), strict=True):
                        out[n].append(v)
            return out

        return f

    text = F.col(text_col)
    if label_col:
        text = F.concat(F.coalesce(language_of_label(F.col(label_col)), F.lit("")), F.lit("\x1f"), text)
    return map_texts(df.select(F.col(id_col).alias("_i"), text.alias("_t")), "_i", "_t", _SHARES, "doc_id long, lang string, share double, confidence double, kind string", make)


_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("segment", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("confidence", pa.float64())])


def segments(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of sentences of one language: doc_id, segment (from 0), lang, words, confidence. Null and blank texts give none."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(ids: list, texts: list) -> dict:
            out: dict[str, list] = {n: [] for n in _SEGMENTS.names}
            b = judge(m, texts)
            for of, own in groupby(zip(b.of.tolist(), b.lang.tolist(), b.words.tolist(), b.confidence.tolist(), strict=True), key=lambda s: s[0]):
                for j, (lang, run) in enumerate(groupby(own, key=lambda s: s[1])):
                    run = list(run)
                    n = sum(k for _, _, k, _ in run)
                    for name, v in zip(_SEGMENTS.names, (ids[of], j, LANGUAGES[lang], n, sum(k * c for _, _, k, c in run) / n), strict=True):
                        out[name].append(v)
            return out

        return f

    return map_texts(df, id_col, text_col, _SEGMENTS, "doc_id long, segment long, lang string, words long, confidence double", make)
