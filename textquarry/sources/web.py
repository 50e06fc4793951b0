"""Web pages as a Spark data source, and the parsing of pages that were fetched before.

``spark.dataSource.register(WebSource)`` makes ``spark.read.format("web").option("urls", ...)`` fetch addresses on the
executors, with a pause between the requests of a partition. Everything behind the fetch works on stored pages as well.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textquarry.functions.html import html_links, html_metadata, html_text, worth_keeping
from textquarry.functions.text import strip


class WebSource(DataSource):
    """Options: urls (separated by blanks), delay (seconds, 1), timeout (30), agent, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return "url string, body string, status_code int, content_type string, scraped_at timestamp, error string"

    def reader(self, schema) -> DataSourceReader:
        return _WebReader(self.options)


class _WebReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options.get("urls", "").split()
        self.delay, self.timeout = float(options.get("delay", 1.0)), float(options.get("timeout", 30))
        self.agent, self.parts = options.get("agent", "textquarry"), int(options.get("partitions", 8))

    def partitions(self) -> Sequence[InputPartition]:
        n = max(1, min(self.parts, len(self.urls)))
        return [InputPartition(self.urls[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from datetime import UTC, datetime
        from urllib.request import Request, urlopen

        for k, url in enumerate(partition.value):
            if k:
                time.sleep(self.delay)
            now = datetime.now(UTC).replace(tzinfo=None)
            try:
                with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                    charset = r.headers.get_content_charset() or "utf-8"
                    yield url, r.read().decode(charset, "replace"), getattr(r, "status", None), r.headers.get("Content-Type"), now, None
            except Exception as e:  # noqa: BLE001  any failure of a page is that page's error
                yield url, None, None, None, now, str(e)


def parse_pages(fetched: DataFrame, with_links: bool = False) -> DataFrame:
    """url, title, description, text, content_length, status_code, content_type, scraped_at, error[, links] of fetched pages."""
    m = fetched.withColumn("_m", html_metadata("body", "url"))
    cols = ["url", F.col("_m.title").alias("title"), F.col("_m.description").alias("description"), html_text("body").alias("text"), F.length("body").alias("content_length"), "status_code", "content_type", "scraped_at", "error"]
    return m.select(*cols, *([html_links("body", "url").alias("links")] if with_links else []))


def filter_pages(pages: DataFrame, min_length: int = 100, exclude: tuple[str, ...] = ()) -> DataFrame:
    return pages.filter(worth_keeping(F.col("text"), min_length, exclude))


def sitemap_urls(fetched: DataFrame, xml_col: str = "body") -> DataFrame:
    """(url) of every entry of sitemaps."""
    return fetched.select(F.explode(F.regexp_extract_all(xml_col, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).select(F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url"))


def page_documents(pages: DataFrame) -> DataFrame:
    """Pages with text as documents: text, source, title, metadata."""
    has = pages.filter(F.col("text").isNotNull() & (strip(F.col("text")) != ""))
    meta = F.create_map(*(x for n in ("content_type", "scraped_at", "content_length") for x in (F.lit(n), F.col(n).cast("string"))))
    return has.select("text", F.col("url").alias("source"), "title", meta.alias("metadata"))
