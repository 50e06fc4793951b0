"""Public APIs: addresses of searches, their answers fetched on the executors, and records from these.

Every parser takes a DataFrame of payloads and stays in the JVM, so that stored answers are parsed like fresh ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote, urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.sources.web import WebSource

#: Public addresses of the services; each function takes another one as ``base``.
ENCYCLOPEDIA = "https://en.wikipedia.org"
PREPRINTS = "http://export.arxiv.org/api/query"
CRAWL_INDEX = "https://index.commoncrawl.org/CC-MAIN-2023-50-index"
NEWS_BOARD = "https://hn.algolia.com/api/v1/search"
FORUM = "https://www.reddit.com"


# ---- addresses ---------------------------------------------------------------------------------------


def _with(base: str, **query: object) -> str:
    return f"{base}?{urlencode({k: v for k, v in query.items() if v is not None})}"


def encyclopedia_search(query: str, limit: int = 10, base: str = ENCYCLOPEDIA) -> str:
    return _with(f"{base}/w/api.php", action="query", format="json", list="search", srsearch=query, srlimit=limit)


def encyclopedia_summary(title: str, base: str = ENCYCLOPEDIA) -> str:
    return f"{base}/api/rest_v1/page/summary/{quote(title.replace(' ', '_'), safe='')}"


def preprint_search(query: str, most: int = 100, category: str | None = None, base: str = PREPRINTS) -> str:
    terms = f"all:{query}" + (f" AND cat:{category}" if category else "")
    return _with(base, search_query=terms, start=0, max_results=most, sortBy="relevance", sortOrder="descending")


def crawl_search(domain: str, limit: int = 1000, base: str = CRAWL_INDEX) -> str:
    return _with(base, url=f"{domain}/*", limit=limit, output="json")


def news_search(query: str, tags: str = "story", hits: int = 100, base: str = NEWS_BOARD) -> str:
    return _with(base, query=query, tags=tags, hitsPerPage=min(hits, 1000))


def forum_search(community: str, query: str | None = None, limit: int = 100, base: str = FORUM) -> str:
    """Posts of a community that match a query, else those that are hot."""
    if query:
        return _with(f"{base}/r/{quote(community)}/search.json", q=query, limit=limit, sort="relevance")
    return _with(f"{base}/r/{quote(community)}/hot.json", limit=limit)


# ---- fetching ----------------------------------------------------------------------------------------


def fetch(spark: SparkSession, urls: Sequence[str], delay: float = 1.0, timeout: float = 30, partitions: int = 1) -> DataFrame:
    """(url, payload, status_code, error) of each address, with ``delay`` seconds between the requests of a task.

    One service is asked by one task, so that its rate limit holds; several services may have a task each. A request
    that fails has a null payload and its error.
    """
    spark.dataSource.register(WebSource)
    pages = spark.read.format("web").options(urls=" ".join(urls), delay=delay, timeout=timeout, partitions=partitions).load()
    return pages.select("url", F.col("body").alias("payload"), "status_code", "error")


def search_encyclopedia(spark: SparkSession, query: str, limit: int = 10, delay: float = 1.0, base: str = ENCYCLOPEDIA) -> DataFrame:
    """Summaries of the pages that a search finds: the list of titles first, then a request for each."""
    found = fetch(spark, [encyclopedia_search(query, limit, base)], delay)
    titles = found.select(F.explode(F.from_json("payload", "query struct<search: array<struct<title: string>>>")["query"]["search"]["title"]).alias("t"))
    return encyclopedia(fetch(spark, [encyclopedia_summary(r.t, base) for r in titles.limit(limit).collect()], delay))  # ``limit`` titles


def search_preprints(spark: SparkSession, query: str, most: int = 100, category: str | None = None, base: str = PREPRINTS) -> DataFrame:
    return preprints(fetch(spark, [preprint_search(query, most, category, base)]))


def search_crawls(spark: SparkSession, domain: str, limit: int = 1000, base: str = CRAWL_INDEX) -> DataFrame:
    return crawl_index(fetch(spark, [crawl_search(domain, limit, base)]))


def search_news(spark: SparkSession, query: str, tags: str = "story", hits: int = 100, base: str = NEWS_BOARD) -> DataFrame:
    return news_board(fetch(spark, [news_search(query, tags, hits, base)]))


def search_forum(spark: SparkSession, community: str, query: str | None = None, limit: int = 100, base: str = FORUM) -> DataFrame:
    return forum(fetch(spark, [forum_search(community, query, limit, base)]))


def fetch_feeds(spark: SparkSession, urls: Sequence[str], limit: int = 50, delay: float = 1.0) -> DataFrame:
    """Entries of every feed, with ``feed_url``."""
    return feed(fetch(spark, urls, delay), limit, keep=("url",)).withColumnRenamed("url", "feed_url")


# ---- answers -----------------------------------------------------------------------------------------


def _json(df: DataFrame, schema: str, col: str) -> DataFrame:
    return df.select("*", F.from_json(col, schema).alias("_p"))


def _nonblank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def encyclopedia(df: DataFrame, col: str = "payload") -> DataFrame:
    """Summaries of an encyclopedia's pages: title, extract, url, source, timestamp, content_length."""
    p = _json(df, "title string, extract string, content_urls struct<desktop: struct<page: string>>, timestamp string", col)
    return p.filter("_p.title is not null").select("_p.title", "_p.extract", F.col("_p.content_urls.desktop.page").alias("url"), F.lit("encyclopedia").alias("source"), "_p.timestamp", F.length("_p.extract").alias("content_length"))


def preprints(df: DataFrame, col: str = "payload") -> DataFrame:
    """Atom feeds of preprints, an entry a row: title, abstract, authors, published, url, source."""
    entry = df.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?s)<entry[^>]*>(.*?)</entry>"), F.lit(1))).alias("e"))

    def one(tag: str) -> Column:
        return _clean(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))

    authors = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<author>.*?<name>(.*?)</name>"), F.lit(1)), _clean)
    return entry.select(one("title").alias("title"), one("summary").alias("abstract"), authors.alias("authors"), one("published").alias("published"), one("id").alias("url"), F.lit("preprints").alias("source"))


def _clean(c: Column) -> Column:
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^<!\[CDATA\[|\]\]>$", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def crawl_index(df: DataFrame, col: str = "payload") -> DataFrame:
    """A web archive's index, a JSON object a line; lines that do not parse are skipped."""
    lines = df.select(F.explode(F.split(col, "\n")).alias("line")).filter(F.try_parse_json("line").isNotNull() & F.col("line").startswith("{"))
    p = _json(lines, "url string, timestamp string, mime string, status string, digest string, length string, offset string, filename string", "line")
    return p.select("_p.*")


def news_board(df: DataFrame, col: str = "payload") -> DataFrame:
    """Hits of a news board's search: the story's text, else the comment's."""
    p = _json(df, "hits array<struct<objectID: string, title: string, story_text: string, comment_text: string, url: string, author: string, points: int, num_comments: int, created_at: string>>", col)
    h = p.select(F.explode("_p.hits").alias("h"))
    return h.select(F.col("h.objectID").alias("object_id"), "h.title", F.coalesce(_nonblank(F.col("h.story_text")), F.col("h.comment_text")).alias("text"), "h.url", "h.author", F.col("h.points").alias("score"), "h.num_comments", "h.created_at", F.lit("news_board").alias("source"))


def forum(df: DataFrame, col: str = "payload") -> DataFrame:
    """Listings of a forum."""
    p = _json(df, "data struct<children: array<struct<data: struct<id: string, title: string, selftext: string, url: string, author: string, subreddit: string, score: int, num_comments: int, created_utc: double>>>>", col)
    d = p.select(F.explode("_p.data.children").alias("c")).select("c.data.*")
    return d.select(F.col("id").alias("object_id"), "title", F.col("selftext").alias("text"), "url", "author", F.col("subreddit").alias("community"), "score", "num_comments", F.timestamp_seconds("created_utc").alias("created_at"), F.lit("forum").alias("source"))


def feed(df: DataFrame, limit: int = 50, col: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """RSS items, else Atom entries: title, description, link, published; the first ``limit`` of each feed. Columns of ``keep`` stay."""
    items = F.regexp_extract_all(col, F.lit(r"(?s)<item[ >](.*?)</item>"), F.lit(1))
    entries = F.regexp_extract_all(col, F.lit(r"(?s)<entry[ >](.*?)</entry>"), F.lit(1))
    e = df.select(*keep, F.explode(F.slice(F.when(F.size(items) > 0, items).otherwise(entries), 1, limit)).alias("e"))

    def first(*tags: str) -> Column:
        return F.coalesce(*(_nonblank(_clean(F.regexp_extract("e", rf"(?s)<{t}(?: [^>]*)?>(.*?)</{t}>", 1))) for t in tags), F.lit(""))

    link = F.coalesce(_nonblank(_clean(F.regexp_extract("e", r"(?s)<link(?: [^>]*)?>(.*?)</link>", 1))), _nonblank(F.regexp_extract("e", r'<link[^>]*href="([^"]*)"', 1)), F.lit(""))
    return e.select(first("title").alias("title"), first("description", "summary", "content").alias("description"), link.alias("link"), first("pubDate", "published", "updated").alias("published"), F.lit("feed").alias("source"), *keep)


def documents(records: DataFrame) -> DataFrame:
    """Records as documents: ``extract``, ``abstract`` or ``summary`` becomes ``text``; other columns go to metadata as JSON."""
    name = next((c for c in ("text", "extract", "abstract", "summary") if c in records.columns), None)
    if name is None:
        return records.sparkSession.createDataFrame([], "text string, source string, title string, metadata string")
    rest = [c for c in records.columns if c not in (name, "source", "title")]
    has = records.filter(F.trim(F.col(name)) != "")
    return has.select(F.col(name).alias("text"), *(F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in ("source", "title")), F.to_json(F.struct(*rest)).alias("metadata"))
