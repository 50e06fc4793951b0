"""Text, links and metadata of HTML pages, by the standard library's parser, one pass over each page."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Elements whose content is no text of the page.
FURNITURE = frozenset(("script", "style", "nav", "footer", "header"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LOOSE = frozenset(("p", "li", "td", "th", "tr", "option", "dt", "dd"))


class Page(HTMLParser):
    """Collects what a page holds; unclosed elements end with what encloses them."""

    def __init__(self, base: str = "", drop: frozenset[str] = FURNITURE):
        super().__init__(convert_charrefs=True)
        self.base, self.drop = base, drop
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title: str | None = None
        self.meta: dict[str, str] = {}
        self.canonical: str | None = None
        self._open: list[str] = []
        self._hidden = 0
        self._in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = {k: v or "" for k, v in attrs}
        if tag == "a" and at.get("href"):
            self.links.append(urljoin(self.base, at["href"]) if self.base else at["href"])
        elif tag == "meta" and (name := (at.get("name") or at.get("property") or "").lower()):
            self.meta[name] = at.get("content", "")
        elif tag == "link" and "canonical" in at.get("rel", "").lower().split() and at.get("href"):
            self.canonical = urljoin(self.base, at["href"]) if self.base else at["href"]
        if tag not in _VOID:
            self._open.append(tag)
            self._hidden += tag in self.drop
            if tag == "title" and self.title is None:
                self._in_title, self.title = True, ""

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._in_title = False
        if tag not in self._open:
            return
        while self._open:
            t = self._open.pop()
            self._hidden -= t in self.drop
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title = (self.title or "") + data
        if not self._hidden:
            self.parts.append(data)

    def text(self) -> str:
        """Phrases between line breaks and double blanks, joined by one blank."""
        pieces = (piece.strip() for line in "".join(self.parts).splitlines() for piece in line.strip().split("  "))
        return " ".join(p for p in pieces if p)


def read(page: str, base: str = "", drop: frozenset[str] = FURNITURE) -> Page:
    p = Page(base, drop)
    p.feed(page)
    p.close()
    return p


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Text without scripts, styles and page furniture; the title in the head counts as text."""
    return pages.map(lambda x: read(x).text(), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def html_links(pages: pd.Series, bases: pd.Series) -> pd.Series:
    """Targets of all links in their order, repeats kept, made absolute."""
    return pd.Series([None if x is None else read(x, b or "").links for x, b in zip(pages, bases, strict=True)])


_META = StructType([StructField(n, StringType()) for n in ("title", "description", "keywords", "language", "canonical")] + [StructField("content_length", LongType())])


@F.pandas_udf(_META)
def html_metadata(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """Title, description, keywords, language, canonical address (the page's own by default) and size in bytes."""
    rows = []
    for x, u in zip(pages, urls, strict=True):
        if x is None:
            rows.append((None,) * 6)
            continue
        p = read(x, u or "")
        title = re.sub(r"\s+", " ", p.title).strip() if p.title else p.title
        rows.append((title, p.meta.get("description"), p.meta.get("keywords"), p.meta.get("language") or p.meta.get("og:locale"), p.canonical or u, len(x.encode())))
    return pd.DataFrame(rows, columns=[f.name for f in _META.fields])


def worth_keeping(text: Column, min_length: int = 100, exclude: tuple[str, ...] = ()) -> Column:
    """Long enough, and none of the patterns occurs, in whatever case."""
    ok = F.length(text) >= min_length
    for pattern in exclude:
        ok = ok & ~text.rlike(f"(?i){pattern}")
    return F.coalesce(ok, F.lit(False))
