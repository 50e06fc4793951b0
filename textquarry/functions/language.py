"""A language vote over function words, wholly in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import lower_words, strip

#: Function words that few other languages share.
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "den", "dem", "mit", "für", "auf", "von", "zu", "im", "wird", "auch", "weil", "über"),
    "en": ("the", "and", "of", "to", "is", "that", "for", "with", "was", "on", "are", "this", "it", "by", "from", "not", "which", "because", "an", "were"),
    "es": ("el", "los", "las", "y", "que", "una", "por", "con", "para", "del", "pero", "más", "como", "está", "muy", "porque", "también", "su", "lo", "al"),
    "fr": ("le", "les", "et", "des", "est", "une", "dans", "qui", "pour", "du", "pas", "sur", "avec", "au", "mais", "ce", "sont", "aux", "parce", "plus"),
    "it": ("il", "gli", "e", "che", "di", "della", "sono", "per", "una", "non", "con", "nel", "perché", "più", "alla", "dei", "anche", "ma", "questo", "è"),
    "nl": ("het", "een", "en", "van", "niet", "dat", "op", "voor", "met", "zijn", "aan", "ook", "wordt", "omdat", "naar", "uit", "bij", "maar", "deze", "elke"),
    "pt": ("o", "os", "e", "que", "não", "uma", "do", "da", "em", "para", "com", "mas", "dos", "por", "mais", "também", "ao", "no", "na", "são"),
    "ru": ("и", "в", "не", "на", "что", "с", "по", "но", "как", "это", "из", "для", "от", "потому", "почему", "его", "она", "они", "после", "без"),
}


def language_votes(text: Column) -> Column:
    """Languages with their share of all votes, best first; empty without any vote."""
    w = lower_words(text)

    def hits(own: tuple[str, ...]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*own)))

    votes = F.array(*(F.struct(hits(own).alias("n"), F.lit(lang).alias("lang")) for lang, own in FUNCTION_WORDS.items()))
    total = F.aggregate(votes, F.lit(0), lambda acc, v: acc + v["n"])
    ranked = F.array_sort(F.filter(votes, lambda v: v["n"] > 0), lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["lang"] < b["lang"], -1).otherwise(1))
    return F.transform(ranked, lambda v: F.struct(v["lang"].alias("lang"), (v["n"] / total).alias("prob")))


def detect_language(text: Column, shortest: int = 50) -> Column:
    """The language with most votes; null for texts under ``shortest`` characters and those without votes."""
    return F.when(F.length(strip(text)) >= shortest, F.try_element_at(language_votes(text), F.lit(1))["lang"])


def is_language(text: Column, langs: Sequence[str]) -> Column:
    """Undetected texts are not kept."""
    return F.coalesce(detect_language(text).isin(*langs), F.lit(False))
