"""Words, sentences and n-grams as Column expressions; the pattern classes mean the same in Spark and in SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: A token of the simple tokenizer: a word, or one sign that is neither word nor blank.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Runs of end marks that part sentences.
ENDS = r"[.!?]+"
#: White space of any script, spelled out so that every engine reads it alike.
BLANK = "[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def raw_sentences(text: Column) -> Column:
    """Pieces between end marks, blank ones included."""
    return F.split(text, ENDS)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def sentences(text: Column) -> Column:
    """Pieces between end marks, stripped, without blank ones."""
    return F.filter(F.transform(raw_sentences(text), strip), lambda s: s != "")


def ngrams(array: Column, n: int) -> Column:
    """Runs of n elements, joined by a blank; none in shorter arrays."""
    runs = F.transform(F.sequence(F.lit(1), F.size(array) - (n - 1)), lambda i: F.array_join(F.slice(array, i, n), " "))
    return F.when(F.size(array) >= n, runs).otherwise(F.array().cast("array<string>"))


def count(array: Column) -> Column:
    return F.size(array).cast("long")


def ratio(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """part / whole as a double, ``otherwise`` where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(otherwise))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
