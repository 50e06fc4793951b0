"""Document filters: conditions as Columns, combined without shuffles; counts of all steps come from one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import metrics
from textquarry.functions import text as T
from textquarry.functions.language import language_votes
from textquarry.operators.dedup import greedy_overlap_removed
from textquarry.runtime import materialize

#: Words counted as toxic, and the kinds of content with their cue words and confidence.
TOXIC = ("hate", "racist", "sexist", "offensive", "discrimination", "violence", "threat", "harassment", "bullying", "abuse")
CONTENT_TYPES = (
    ("recipe", r"\b(recipe|ingredients|cooking|bake|cook)\b", 0.8),
    ("news", r"\b(news|reported|according to|sources)\b", 0.7),
    ("academic", r"\b(abstract|introduction|methodology|conclusion)\b", 0.8),
    ("review", r"\b(review|rating|stars|recommend)\b", 0.7),
    ("tutorial", r"\b(tutorial|how to|step|guide)\b", 0.8),
)
GENERAL = ("general", 0.5)


@dataclass(frozen=True)
class Filter:
    """A named condition on a text; documents without text always pass."""

    name: str
    condition: Callable[[Column], Column]

    def keep(self, text: Column) -> Column:
        return F.coalesce(self.condition(text), F.lit(True)) | text.isNull()

    def apply(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.filter(self.keep(F.col(text_col)))

    def statistics(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return _counts(df.agg(F.count("*").alias("original"), F.count_if(self.keep(F.col(text_col))).alias("filtered")))


def _counts(df: DataFrame) -> DataFrame:
    removed = F.col("original") - F.col("filtered")
    return df.withColumn("removed", removed).withColumn("removal_rate", T.ratio(removed, F.col("original")))


def size_of(text: Column, unit: str) -> Column:
    """Length in characters, words, or pieces between end marks (a closing mark leaves an empty last piece)."""
    if unit == "characters":
        return F.length(text).cast("long")
    if unit == "words":
        return T.count(T.words(text))
    if unit == "sentences":
        return T.count(T.raw_sentences(T.strip(text)))
    raise ValueError(f"unknown unit: {unit}")


def length_filter(least: int = 0, most: int | None = None, unit: str = "characters") -> Filter:
    return Filter(f"length_{unit}", lambda t: size_of(t, unit) >= least if most is None else size_of(t, unit).between(least, most))


def language_filter(langs: Sequence[str], confidence: float = 0.7) -> Filter:
    """Texts under 50 characters and those without any vote pass."""

    def keep(t: Column) -> Column:
        votes = language_votes(t)
        return (F.length(T.strip(t)) < 50) | (F.size(votes) == 0) | F.exists(votes, lambda v: v["lang"].isin(*langs) & (v["prob"] >= confidence))

    return Filter("language", keep)


def toxicity(text: Column) -> Column:
    """Share of toxic words; 0 without words."""
    w = T.lower_words(text)
    return T.ratio(F.size(F.filter(w, lambda x: x.isin(*TOXIC))), F.size(w))


def toxicity_filter(most: float = 0.3) -> Filter:
    return Filter("toxicity", lambda t: toxicity(t) <= most)


def content_type(text: Column) -> Column:
    """(type, confidence) by the first kind whose cue words occur."""
    low = F.lower(text)
    out = F.struct(F.lit(GENERAL[0]).alias("type"), F.lit(GENERAL[1]).alias("confidence"))
    for name, pattern, confidence in reversed(CONTENT_TYPES):
        out = F.when(low.rlike(pattern), F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def content_type_filter(allowed: Sequence[str], confidence: float = 0.6) -> Filter:
    return Filter("content_type", lambda t: content_type(t)["type"].isin(*allowed) & (content_type(t)["confidence"] >= confidence))


def quality_filter(df: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents of at least this quality; ``score`` may give another (id, quality_score). Documents without text pass."""
    scores = materialize((score(df) if score else metrics.all_metrics(df, text_col, (id_col,))).select(id_col, "quality_score"))  # else the condition repeats every metric
    good = scores.filter(F.col("quality_score") >= least).select(id_col).distinct()
    return df.filter(F.col(text_col).isNotNull()).join(good, id_col, "left_semi").unionByName(df.filter(F.col(text_col).isNull()))


def perplexity_filter(df: DataFrame, most: float = 1000.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose own word distribution has at most this perplexity; none without words, all without text."""
    m = metrics.measured(df, text_col, (id_col,)).select(id_col, metrics.perplexity().alias("p")).filter(F.col("p") <= most).select(id_col).distinct()
    return df.filter(F.col(text_col).isNotNull()).join(m, id_col, "left_semi").unionByName(df.filter(F.col(text_col).isNull()))


def duplicate_filter(df: DataFrame, similarity: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text kept unless its word set is this similar to one kept before it."""
    removed = greedy_overlap_removed(df, id_col, text_col, similarity, strict=False, least_length_ratio=0.0)
    return df.join(removed, df[id_col] == removed["doc_id"], "left_anti")


def composite(filters: Sequence[Filter], logic: str = "and") -> Filter:
    """All or any of the filters; without filters everything passes."""
    if logic not in ("and", "or"):
        raise ValueError(f"unknown logic: {logic}")

    def keep(t: Column) -> Column:
        if not filters:
            return F.lit(True)
        return reduce(lambda a, b: a & b if logic == "and" else a | b, [f.keep(t) for f in filters])

    return Filter(logic, keep)


def composite_statistics(df: DataFrame, filters: Sequence[Filter], logic: str = "and", text_col: str = "text") -> DataFrame:
    """A row for each filter and one for the whole, all on the full input."""
    every = [*filters, composite(filters, logic)]
    t = F.col(text_col)
    one = df.agg(F.count("*").alias("original"), *(F.count_if(f.keep(t)).alias(f"k{i}") for i, f in enumerate(every)))
    rows = F.array(*(F.struct(F.lit(f.name).alias("filter"), F.col(f"k{i}").alias("filtered")) for i, f in enumerate(every)))
    return _counts(one.select("original", F.inline(rows)).select("filter", "original", "filtered"))


class FilterPipeline:
    """Filters one after the other."""

    def __init__(self, filters: Sequence[Filter] = ()):
        self.filters = list(filters)

    def add_filter(self, f: Filter) -> FilterPipeline:
        self.filters.append(f)
        return self

    def process(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        t = F.col(text_col)
        return df.filter(reduce(lambda a, b: a & b, [f.keep(t) for f in self.filters], F.lit(True)))

    def statistics(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """A row for each step: before, after, removed and the rate; the texts are scanned once for all steps."""
        t = F.col(text_col)
        passed = [F.lit(True)]
        for f in self.filters:
            passed.append(passed[-1] & f.keep(t))
        one = df.agg(*(F.count_if(p).alias(f"k{i}") for i, p in enumerate(passed)))
        rows = F.array(*(F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(f.name).alias("filter"), F.col(f"k{i}").alias("original"), F.col(f"k{i + 1}").alias("filtered")) for i, f in enumerate(self.filters)))
        return _counts(one.select(F.inline(rows)))
