"""Text cleaning as Column expressions; HTML, repair of wrong decodings and Unicode normal forms as Arrow functions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textquarry.functions.text import BLANK, strip

#: What the cleaner takes for an address. The class from $ to _ covers most signs and digits.
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def strip_tags(text: str) -> str:
    """Character references read first, then tags dropped; scripts and styles are no text."""
    parser = _Text()
    parser.feed(html.unescape(text))
    parser.close()
    return "".join(parser.out)


@F.pandas_udf(StringType())
def _html_text(texts: pd.Series) -> pd.Series:
    return texts.map(strip_tags, na_action="ignore")


def clean_html(text: Column) -> Column:
    """Only texts with a sign of markup reach Python."""
    return F.when(text.rlike("[<&]"), _html_text(text)).otherwise(text)


_WRONG = re.compile("[ÂÃâÐÑ][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")


def redecode(text: str) -> str:
    """UTF-8 that was read under a Western code page, read again; unchanged where that is impossible."""
    for _ in range(2):
        if not _WRONG.search(text):
            return text
        for codec in ("cp1252", "latin-1"):
            try:
                text = text.encode(codec).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        else:
            return text
    return text


@F.pandas_udf(StringType())
def _redecoded(texts: pd.Series) -> pd.Series:
    return texts.map(redecode, na_action="ignore")


def fix_encoding(text: Column) -> Column:
    return F.when(text.rlike("[ÂÃâÐÑ]"), _redecoded(text)).otherwise(text)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normal_form(text: Column) -> Column:
    """NFKC; pure ASCII is its own normal form and stays in the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def remove_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def remove_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "")


def collapse_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{BLANK}+", " "))


def java_replacement(template: str) -> str:
    r"""A replacement with back references \1 written with $1; a plain dollar is escaped."""
    return re.sub(r"\\(\d)", r"$\1", template.replace("$", r"\$"))


@dataclass
class TextCleaner:
    """The cleaning chain; steps run in the order in which they are listed here."""

    remove_html: bool = True
    fix_encoding: bool = True
    normalize_unicode: bool = True
    remove_urls: bool = False
    remove_emails: bool = False
    custom_patterns: Mapping[str, str] = field(default_factory=dict)
    normalize_whitespace: bool = True
    min_length: int = 0
    max_length: int | None = None

    def expression(self, text: Column) -> Column:
        """The cleaned text, null where its length is out of bounds."""
        for on, step in ((self.remove_html, clean_html), (self.fix_encoding, fix_encoding), (self.normalize_unicode, normal_form), (True, remove_control), (self.remove_urls, remove_urls), (self.remove_emails, remove_emails)):
            text = step(text) if on else text
        for pattern, new in self.custom_patterns.items():
            text = F.regexp_replace(text, pattern, java_replacement(new))
        text = collapse_blanks(text) if self.normalize_whitespace else text
        ok = F.length(text) >= self.min_length
        if self.max_length:
            ok = ok & (F.length(text) <= self.max_length)
        return F.when(ok, text)

    def clean(self, df: DataFrame, fields: tuple[str, ...] = ("text", "content")) -> DataFrame:
        """Rows whose string columns among ``fields`` all clean well; others of a different type are left as they are."""
        for name in (n for n, kind in df.dtypes if n in fields and kind == "string"):
            df = df.withColumn("_clean", self.expression(F.col(name))).filter(F.col("_clean").isNotNull()).withColumn(name, F.col("_clean")).drop("_clean")
        return df

    def statistics(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """One row: texts before and after, rate kept, characters in all and on average, share of characters removed."""
        both = df.select(F.col(text_col).alias("a"), self.expression(F.col(text_col)).alias("b")).filter("a is not null")
        n, k, ca, cb = F.count("a"), F.count("b"), F.coalesce(F.sum(F.length("a")), F.lit(0)).cast("long"), F.coalesce(F.sum(F.length("b")), F.lit(0)).cast("long")
        return both.agg(n.alias("texts"), k.alias("kept"), F.when(n > 0, k / n).otherwise(0.0).alias("kept_rate"), ca.alias("chars_before"), cb.alias("chars_after"), F.when(n > 0, ca / n).otherwise(0.0).alias("mean_before"), F.when(k > 0, cb / k).otherwise(0.0).alias("mean_after"), F.when(ca > 0, 1 - cb / ca).otherwise(0.0).alias("char_reduction_rate"))
