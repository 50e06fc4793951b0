"""Text metrics as Column expressions over arrays of words and sentences that are computed once.

``measured`` adds the arrays and all counts; every metric is arithmetic over them. Nothing leaves the JVM but MTLD,
whose scan keeps a growing set.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textquarry.functions import text as T

VOWELS = "[aeiouy]+"


def syllables(word: Column) -> Column:
    """Vowel runs of a lower-case word, one less for a silent final e, one at least."""
    runs = F.size(F.regexp_extract_all(word, F.lit(VOWELS), F.lit(0)))
    return F.greatest(F.lit(1), F.when(word.endswith("e") & (runs > 1), runs - 1).otherwise(runs))


def is_complex(word: Column) -> Column:
    """Three syllables and more, no name, no plain inflection."""
    return (F.length(word) > 2) & ~word.rlike(r"^\p{Lu}") & ~word.rlike("(?:es|ed|ing)$") & (syllables(F.lower(word)) >= 3)


#: The bounds and patterns of misspelled are fixed values.
def misspelled(word: Column) -> Column:
    low = F.lower(word)
    return (F.length(word) < 2) | (F.length(word) > 20) | low.rlike("[bcdfghjklmnpqrstvwxz]{4,}") | low.rlike("[aeiou]{4,}") | low.rlike(r"\d.*[a-z].*\d")


def punctuated(sentence: Column) -> Column:
    """0 to 2: a capital first, and signs on less than a tenth of it."""
    signs = F.length(F.regexp_replace(sentence, rf"[\p{{L}}\p{{N}}_]|{T.BLANK}", ""))
    return F.when(sentence.rlike(r"^\p{Lu}"), 1).otherwise(0) + F.when(signs < 0.1 * F.length(sentence), 1).otherwise(0)


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + f(x).cast("long"))


def measured(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the arrays and counts that the metrics share; rows without text are left out."""
    t = F.col(text_col)
    base = df.filter(t.isNotNull()).select(*keep, t.alias("t"), T.words(t).alias("w"), T.lower_words(t).alias("lw"), T.sentences(t).alias("s"))
    return base.select(
        *keep, "t", "w", "lw", "s",
        T.count(F.col("w")).alias("n_words"), T.count(F.col("s")).alias("n_sentences"), F.length("t").cast("long").alias("n_chars_all"),
        F.length(F.regexp_replace("t", T.BLANK, "")).cast("long").alias("n_solid"), T.count(T.raw_sentences(F.col("t"))).alias("n_pieces"),
        _sum(F.col("lw"), syllables).alias("n_syllables"),
        T.count(F.filter("lw", lambda x: syllables(x) >= 3)).alias("n_poly"),
        T.count(F.filter("w", is_complex)).alias("n_complex"),
    )


def _per_sentence() -> Column:
    return F.col("n_words") / F.col("n_sentences")


def _both() -> Column:
    return (F.col("n_words") > 0) & (F.col("n_sentences") > 0)


def flesch_reading_ease() -> Column:
    score = 206.835 - 1.015 * _per_sentence() - 84.6 * (F.col("n_syllables") / F.col("n_words"))
    return F.when(_both(), T.clamp(score, 0.0, 100.0)).otherwise(F.lit(0.0))


def flesch_kincaid_grade() -> Column:
    return F.when(_both(), F.greatest(F.lit(0.0), 0.39 * _per_sentence() + 11.8 * (F.col("n_syllables") / F.col("n_words")) - 15.59)).otherwise(F.lit(0.0))


def smog_index() -> Column:
    return F.when(F.col("n_sentences") >= 3, 1.0430 * F.sqrt(F.col("n_poly") * 30.0 / F.col("n_sentences")) + 3.1291).otherwise(F.lit(0.0))


def automated_readability_index() -> Column:
    return F.when(_both(), F.greatest(F.lit(0.0), 4.71 * (F.col("n_solid") / F.col("n_words")) + 0.5 * _per_sentence() - 21.43)).otherwise(F.lit(0.0))


def gunning_fog_index() -> Column:
    return F.when(_both(), 0.4 * (_per_sentence() + 100.0 * F.col("n_complex") / F.col("n_words"))).otherwise(F.lit(0.0))


def vocabulary_richness() -> Column:
    return T.ratio(F.size(F.array_distinct("lw")), F.col("n_words"))


def ngram_diversity(n: int) -> Column:
    grams = T.ngrams(F.col("lw"), n)
    return F.when(F.col("n_words") >= n, F.size(F.array_distinct(grams)) / (F.col("n_words") - (n - 1))).otherwise(F.lit(0.0))


def entropy() -> Column:
    """Entropy in bits of a document's own words; runs of equal words of the sorted array are counted."""
    srt = F.array_sort("lw")
    step = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))

    def term(k: Column) -> Column:
        return F.when(k > 1, k * F.log2(k.cast("double"))).otherwise(F.lit(0.0))

    def add(acc: Column, x: Column) -> Column:
        same = acc["last"] == x
        return F.struct(x.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + term(acc["run"])).alias("sum"))

    total = F.aggregate(srt, step, add, lambda acc: acc["sum"] + term(acc["run"]))
    n = F.col("n_words").cast("double")
    return F.when(F.col("n_words") > 0, F.greatest(F.lit(0.0), F.log2(n) - total / n)).otherwise(F.lit(0.0))


def repetitiveness() -> Column:
    """1 minus the entropy over its largest value; 1 without words and for one word only."""
    kinds = F.size(F.array_distinct("lw"))
    return F.when(kinds > 1, T.clamp(1 - entropy() / F.log2(kinds.cast("double")))).otherwise(F.lit(1.0))


def perplexity() -> Column:
    """2 to the entropy of a document's own words; infinite without words."""
    return F.when(F.col("n_words") > 0, F.pow(F.lit(2.0), entropy())).otherwise(F.lit(float("inf")))


def spelling_error_ratio() -> Column:
    return T.ratio(F.size(F.filter("w", misspelled)), F.col("n_words"))


def punctuation_quality() -> Column:
    return T.ratio(_sum(F.col("s"), punctuated), 2 * F.col("n_sentences"))


def coherence() -> Column:
    """Mean overlap of the word sets of neighbouring sentences; 0.5 for fewer than two sentences, 0 without any pair."""
    sets = F.transform("s", lambda x: F.array_distinct(T.lower_words(x)))
    pairs = F.filter(F.arrays_zip(F.slice(sets, 1, F.size("s") - 1).alias("a"), F.slice(sets, 2, F.size("s") - 1).alias("b")), lambda p: (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0))
    overlaps = F.transform(pairs, lambda p: F.size(F.array_intersect(p["a"], p["b"])) / F.size(F.array_union(p["a"], p["b"])))
    mean = F.when(F.size(overlaps) > 0, F.aggregate(overlaps, F.lit(0.0), lambda acc, x: acc + x) / F.size(overlaps)).otherwise(F.lit(0.0))
    return F.when(F.col("n_sentences") < 2, F.lit(0.5)).otherwise(mean)


@F.pandas_udf(DoubleType())
def lexical_diversity(texts: pd.Series) -> pd.Series:
    """Mean length of the runs of words over which the share of different ones stays above 0.72 (forward MTLD).

    0 below 50 words; runs of fewer than 10 words do not count, the last one may be unfinished.
    """
    import re

    def one(text: str | None) -> float:
        found = re.findall(r"\w+", text.lower()) if text else []
        if len(found) < 50:
            return 0.0
        runs, seen, start = [], set(), 0
        for i, w in enumerate(found):
            seen.add(w)
            n = i - start + 1
            if len(seen) / n <= 0.72 or i == len(found) - 1:
                if n >= 10:
                    runs.append(n)
                seen, start = set(), i + 1
        return sum(runs) / len(runs) if runs else 0.0

    return texts.map(one).astype(float)


METRICS = {
    "flesch_reading_ease": flesch_reading_ease, "flesch_kincaid_grade": flesch_kincaid_grade, "smog_index": smog_index,
    "automated_readability_index": automated_readability_index, "gunning_fog_index": gunning_fog_index,
    "vocabulary_richness": vocabulary_richness, "bigram_diversity": lambda: ngram_diversity(2), "trigram_diversity": lambda: ngram_diversity(3),
    "repetitiveness": repetitiveness, "spelling_error_ratio": spelling_error_ratio, "punctuation_quality": punctuation_quality, "coherence": coherence,
    "avg_word_length": lambda: T.ratio(_sum(F.col("w"), F.length), F.col("n_words")), "avg_sentence_length": lambda: T.ratio(F.col("n_words"), F.col("n_sentences")),
}


def quality_score() -> Column:
    """Composite of readability, diversity and language quality, from columns named as in METRICS."""
    reading = (F.col("flesch_reading_ease") / 100 + F.greatest(F.lit(0.0), 1 - F.abs(F.col("flesch_kincaid_grade") - 10) / 10)) / 2
    diversity = (F.col("vocabulary_richness") + F.col("bigram_diversity") + (1 - F.col("repetitiveness"))) / 3
    language = ((1 - F.col("spelling_error_ratio")) + F.col("punctuation_quality") + F.col("coherence")) / 3
    return T.clamp(0.3 * reading + 0.3 * diversity + 0.4 * language)


def all_metrics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, every metric, counts and the quality score. Blank texts have all zeros; rows without text are left out."""
    m = measured(df, text_col, keep)
    blank = T.strip(F.col("t")) == ""
    out = m.select(*keep, blank.alias("blank"), *(F.when(blank, F.lit(0.0)).otherwise(f()).alias(n) for n, f in METRICS.items()), *(F.when(blank, F.lit(0).cast("long")).otherwise(F.col(c)).alias(n) for n, c in (("word_count", "n_words"), ("char_count", "n_chars_all"), ("sentence_count", "n_pieces"))))
    return out.withColumn("quality_score", F.when(F.col("blank"), F.lit(0.0)).otherwise(quality_score())).drop("blank")
