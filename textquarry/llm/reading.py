"""Reading level of English text.

Method: classic readability formulas over sentence length and syllables, with syllables counted by hyphenation-style
patterns (numbers between letters, odd ones break, the highest wins), and the median of the grade estimates. Where a
text for beginners ends and one for specialists begins is fitted on a bounded, seeded sample of labelled texts.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm import language
from textquarry.llm.encoding import repair
from textquarry.llm.shape import COMMON, kind_of
from textquarry.runtime import map_texts

#: Patterns between letters: V a vowel letter, C a consonant letter, small letters themselves, a dot the word's end.
#: An odd number lets a syllable begin there, an even one forbids it, the highest at a place decides.
PATTERNS = (
    "V1CV", "VC1CV", "VCC1CV", "VCCC1CV", "VCCCC1CV",
    "V1C2hV", "V1C2rV", "V1C2lV", "V1qu2V", "qu2V",
    "i1a", "i1o", "i1u", "e1o", "u1a", "u1o", "y1a", "y1o", "i1e2t", "e1a2t.", "o1e2t", "u1ou", "i1ou", "u1i2t", "a1o", "o1i2n", "e1i2ng", "y1i2ng", "o1i2ng", "u1i2ng", "a1i2sm", "e1u2m.", "i1u2m.",
    "t4ia", "t4io", "s4io", "c4ia", "c4io", "g4io", "x4io", "t4iou", "c4iou", "g4iou", "ti4a", "ti4o", "si4o", "ci4a", "ci4o", "gi4o", "xi4o", "ti4ou", "ci4ou", "gi4ou", "gu4a", "qu4a", "qu4o", "eo4u",
    "C4e.", "V4Ce.", "VC4Ce.", "V4Ces.", "V4Ced.", "VC4Ced.", "VCC4Ced.", "VC4Ces.", "C1Cle5.", "VC5Cle.", "V5Cle.", "VCC5le.", "VC5tles.", "VC5bles.",
    "Vt5ed.", "Vd5ed.", "V5ted.", "V5ded.", "VC5ted.", "VC5ded.", "VCC5ted.", "V5ses.", "V5ces.", "V5ges.", "V5zes.", "VC5ses.", "VC5ces.", "VC5ges.", "VC5ches.", "V5ches.", "V5shes.", "VC5xes.", "V5xes.",
    "V4Cely.", "VC4Cely.", "V4Cement", "V4Ceful", "V4Celess", "V4Ceness",
)
_VOWELS = frozenset("aeiouyáàâäéèêëíìîïóòôöúùûü")


@lru_cache(maxsize=1)
def _compiled() -> tuple[tuple[re.Pattern, tuple[tuple[int, int], ...]], ...]:
    out = []
    for p in PATTERNS:
        levels, body, n = [], "", 0
        for ch in p:
            if ch.isdigit():
                levels.append((n, int(ch)))
            else:
                # two characters stand for each letter: itself and its class
                body += r"\.\." if ch == "." else ("." + ch if ch in "VC" else re.escape(ch) + ".")
                n += 1
        out.append((re.compile(f"(?=({body}))"), tuple(levels)))
    return tuple(out)


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of a word in lower case, one at least."""
    letters = "".join(ch for ch in word.lower() if ch.isalpha())
    if not any(ch in _VOWELS for ch in letters):
        return 1
    coded = ".." + "".join(ch + ("C" if ch == "y" and i == 0 else "V" if ch in _VOWELS else "C") for i, ch in enumerate(letters)) + ".."
    level = [0] * (len(letters) + 3)
    for pattern, places in _compiled():
        for m in pattern.finditer(coded):
            if m.start() % 2 == 0:
                at = m.start() // 2
                for k, v in places:
                    level[at + k] = max(level[at + k], v)
    return 1 + sum(x % 2 for x in level[2 : len(letters) + 1])


_TERMINAL = re.compile(r"[.!?…]+(?=[\s\"”'’»)\]]|$)")
_ABBREVIATIONS = ("cf.", "e.g.", "i.e.", "etc.", "vs.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Fig.", "approx.", "St.")
_CLAUSE = re.compile(r"[,;:]\s+(?:and|but|so|or|then|yet)\s+(?:then\s+)?|;\s+")
_PARAGRAPH = re.compile(r"\n\s*\n|</?(?:p|div|h[1-6]|li|td|tr|br)\b[^<>]*>|&lt;/?(?:p|div|h[1-6]|li|td|tr)\b.*?&gt;", re.I)
_BLANK_LINE = re.compile(r"\n\s*\n")
#: Words of which English running text has some.
_SOME_ENGLISH = re.compile(r"\b(?:the|of|and|was|you|with|some|not|did|has|had|can|it|is|for)\b", re.I)
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={2,}|'''|\\(?:sub)*section|[-*•–]\s|\d+[.)]\s)")
_ENGLISH = frozenset(COMMON["en"].split())


def running_sentences(text: str) -> list[list[str]]:
    """Words of the sentences and independent clauses of running text; headings and entries without an end mark are left out.

    Where the text has hardly any end marks, each line is a sentence.
    """
    find = language._WORD.findall
    for x in _ABBREVIATIONS:
        if x in text:
            text = text.replace(" " + x, " " + x.replace(".", "")).replace("(" + x, "(" + x.replace(".", ""))
    text = _CLAUSE.sub(". ", text)  # independent clauses count as sentences, as the older formulas ask
    marked = bool(language._MARKED.search(text))
    if (text.count(". ") + text.count("?") + text.count("!") + text.count(".\n") + 1) * 60 < text.count(" ") and "\n" in text.strip():
        lines = [find(ln) for ln in (language._DROP.sub(" ", text) if marked else text).splitlines()]
        return [ws for ws in lines if len(ws) >= 3]
    out = []
    for paragraph in _PARAGRAPH.split(text) if marked else _BLANK_LINE.split(text):
        if not paragraph or not _TERMINAL.search(paragraph):
            continue
        if marked:
            paragraph = language._DROP.sub(" ", paragraph)
        if _HEADING.match(paragraph):
            first, _, rest = paragraph.partition("\n")
            paragraph = rest if len(first) < 120 and not _TERMINAL.search(first.strip("*_' ")) and rest else paragraph
        for s in _TERMINAL.split(paragraph):
            ws = find(s)
            if len(ws) > 1:
                out.append(ws)
    return out


class _Syllables(dict):
    """Syllables by word as written; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        n = self[word] = syllables(word)
        return n


_COUNTED = _Syllables()


def grades(sents: list[list[str]]) -> tuple[float, ...]:
    """Grade estimates of Flesch-Kincaid, SMOG, ARI, Coleman-Liau, FORCAST, and of LIX put on the scale of grades."""
    words = [w for s in sents for w in s]
    n, k = len(words), len(sents)
    syl = list(map(_COUNTED.__getitem__, words))
    sizes = list(map(len, words))
    letters = sum(sizes)
    one = syl.count(1)
    many = n - one - syl.count(2)
    long = sum(x > 6 for x in sizes)
    per = n / k
    return (
        0.39 * per + 11.8 * sum(syl) / n - 15.59,
        1.0430 * math.sqrt(many * 30 / k) + 3.1291,
        4.71 * letters / n + 0.5 * per - 21.43,
        5.88 * letters / n - 29.6 * k / n - 15.8,
        20 - 15 * one / n,
        (per + 100 * long / n) / 4 - 3.5,
    )


#: Labelled texts of each band, chosen by seeded hash, that the cut points are fitted on at most.
BAND_TEXTS = 1000
#: Cut points where there are no labelled texts on both sides: what school grades call beginners and university readers.
BASIC, ADVANCED = 2.5, 17.0


def reading_level(text: str | None) -> tuple[float, int, int] | None:
    """(median grade, sentences, words) of running text; None for null, blank or wordless texts."""
    if text is None or text.isspace() or not text:
        return None
    if not text.isascii():
        text = repair(text)[1]
    sents = running_sentences(text)
    if not sents:
        return None
    return median(grades(sents)), len(sents), sum(map(len, sents))


_GRADED = pa.schema([("id", pa.int64()), ("grade", pa.float64())])


def cut_point(below: list[float], above: list[float]) -> float | None:
    """The grade that leaves the fewest grades on the wrong side, in the middle of the widest gap that does; None without grades on both sides.

    A few wrong labels move it little: each counts as one error, however far off it is.
    """
    if not below or not above:
        return None
    both = sorted([(g, 1) for g in below] + [(g, -1) for g in above])
    wrong, best = len(below), []
    for (g, side), (after, _) in zip(both, both[1:], strict=False):
        wrong -= side
        if after > g:
            best.append((wrong, g - after, (g + after) / 2))
    return min(best)[2] if best else None


def cut_points(graded: list[tuple[str, float]]) -> tuple[float, float]:
    """The grade up to which a text is basic and the one from which it is advanced, of (band, grade)."""
    basic, middle, advanced = ([g for b, g in graded if b == band] for band in ("basic", "middle", "advanced"))
    low, high = cut_point(basic, middle + advanced), cut_point(basic + middle, advanced)
    return BASIC if low is None else low, ADVANCED if high is None else high


def fit_bands(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", band_col: str = "reading_band", seed: int = 7) -> tuple[float, float]:
    """cut_points of at most BAND_TEXTS labelled texts of each band, or all where there are fewer.

    Labels without a known band, of no text or of several bands at once teach nothing; empty tables give the defaults.
    """
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(band_col)).alias("band")).filter("id is not null and band in ('basic', 'middle', 'advanced')")
    named = named.groupBy("id").agg(F.min("band").alias("band"), F.max("band").alias("_last")).filter("band = _last").withColumn("h", F.xxhash64(F.lit(seed), "id"))
    counts = {r.band: r.n for r in named.groupBy("band").agg(F.count("*").alias("n")).collect()}  # three rows
    keep = F.lit(0)
    drawn = BAND_TEXTS + 6 * BAND_TEXTS**0.5  # so many more that a draw by rate practically never falls short
    for band, n in counts.items():
        keep = F.when(F.col("band") == band, F.lit(min(1_000_000, int(1e6 * drawn / n) + 1))).otherwise(keep)
    rank = F.row_number().over(Window.partitionBy("band").orderBy("h", "id"))
    some = named.filter(F.pmod("h", F.lit(1_000_000)) < keep).withColumn("rank", rank).filter(F.col("rank") <= BAND_TEXTS).select("id", "band")

    def make():
        def f(ids: list, texts: list) -> dict:
            return {"id": ids, "grade": [(reading_level(t) or (None,))[0] for t in texts]}

        return f

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "id")  # at most 3 x BAND_TEXTS rows
    graded = map_texts(texts, "id", "_t", _GRADED, "id long, grade double", make, keep=("band",)).filter("grade is not null")
    return cut_points(sorted((r.band, r.grade) for r in graded.groupBy("id", "band").agg(F.min("grade").alias("grade")).collect()))


def band_of(grade: float, cuts: tuple[float, float] = (BASIC, ADVANCED)) -> str:
    return "basic" if grade <= cuts[0] else "advanced" if grade >= cuts[1] else "middle"


_OUT = pa.schema([("rec_id", pa.int64()), ("grade", pa.float64()), ("sentences", pa.int64()), ("words", pa.int64()), ("band", pa.string()), ("english", pa.bool_()), ("running", pa.bool_())])


def reading_levels(df: DataFrame, model: language.LanguageModel, id_col: str, text_col: str, bands: tuple[str, ...] = ("basic", "middle", "advanced"), cuts: tuple[float, float] = (BASIC, ADVANCED)) -> DataFrame:
    """rec_id, grade, sentences, words, band, english (the only language), running (prose, by its own words).

    Bands end at ``cuts`` (of fit_bands). Only rows of the named bands come out, and none for texts without a single common word of English.
    Null, blank and wordless texts give no row; repeated rows repeat; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(ids: list, texts: list) -> dict:
            out: dict[str, list] = {n: [] for n in _OUT.names}
            rows = []
            for i, t in zip(ids, texts, strict=True):
                if t and _SOME_ENGLISH.search(t) and (r := reading_level(t)) and band_of(r[0], cuts) in bands:
                    rows.append((i, t, r))
            judged = language.judge(m, [t for _, t, _ in rows])
            for j, (i, t, (grade, k, n)) in enumerate(rows):
                english = list(judged.shares(j)) == ["en"]
                band = band_of(grade, cuts)
                running = kind_of(t) == "prose" if english and band != "middle" else None
                for name, v in zip(_OUT.names, (i, grade, k, n, band, english, running), strict=True):
                    out[name].append(v)
            return out

        return f

    return map_texts(df, id_col, text_col, _OUT, "rec_id long, grade double, sentences long, words long, band string, english boolean, running boolean", make)
