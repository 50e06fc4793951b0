"""Queries of the core operators: ``QUERIES`` by name, ``SQL`` where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry import queries_documents, queries_engine  # noqa: F401  they register their queries
from textquarry.operators.filters import TOXIC
from textquarry.registry import QUERIES, SQL, query
from textquarry.runtime import spread, table

__all__ = ["QUERIES", "SQL"]

WORD = r"[\p{L}\p{N}_]+"


@query
def corpus_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-unique texts of 10 to 10,000 characters and toxicity of at most 0.3, by language label."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    bad = F.size(F.filter(w, lambda x: x.isin(*TOXIC)))
    d = spread(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").filter("text is not null")
    # what the texts say is worked out where they lie; only these few values are shuffled
    d = d.select("doc_id", "lang", F.sha2("text", 256).alias("h"), F.length("text").alias("chars"), F.size(w).alias("n"), bad.alias("bad"))
    first = d.groupBy("h").agg(F.min(F.struct("doc_id", "lang", "chars", "n", "bad")).alias("d")).select("d.*")
    first = first.filter(F.col("chars").between(10, 10000) & (F.col("bad") <= 0.3 * F.col("n")))
    return first.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chars").cast("long").alias("chars"), F.round(F.avg("n"), 6).alias("mean_words"))


SQL["corpus_by_language"] = rf"""
with f as (select doc_id, text, lang from documents where text is not null qualify row_number() over (partition by sha256(text) order by doc_id) = 1),
w as (select *, regexp_extract_all(lower(text), '{WORD}') as w from f where length(text) between 10 and 10000)
select lang, count(*) as docs, cast(sum(length(text)) as bigint) as chars, round(avg(len(w)), 6) as mean_words from w
where len(list_filter(w, lambda x: x in ({', '.join(map(repr, TOXIC))}))) <= 0.3 * len(w)
group by lang"""
