"""Queries of the training-text operators: ``QUERIES`` by name, ``SQL`` where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.identity import account_key, page_key
from textquarry.llm import encoding, grouping, language, leaks, markup, mixing, reading, shape, tokens, truncation
from textquarry.runtime import materialize, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), *cols)


# ---- 1: garbled text ---------------------------------------------------------------------------------


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encoding.repair_texts(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    files = encoding.map_values(spread(table(spark, sf_dir, "file_records"), "record_id", "content"), "record_id", "content")
    files = encoding.repair_texts(files, "_rec", "_value")
    found = docs.filter("damaged").select(F.lit("documents").alias("tab"), "rec_id").unionByName(files.filter("damaged").select(F.lit("file_records").alias("tab"), "rec_id"))
    return found.distinct()


@query
def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged documents and values of file records with their text put right; ``column`` is where the text belongs."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("column", F.lit("text"))
    docs = encoding.repair_texts(docs, "doc_id", "text", ("column",)).withColumn("tab", F.lit("documents"))
    files = encoding.map_values(spread(table(spark, sf_dir, "file_records"), "record_id", "content"), "record_id", "content")
    files = encoding.repair_texts(files.withColumnRenamed("_key", "column"), "_rec", "_value", ("column",)).withColumn("tab", F.lit("file_records"))
    return docs.unionByName(files).filter("damaged").select("tab", "rec_id", "column", "repaired", "spans", "encodings", "lost")


# ---- 4: shape ----------------------------------------------------------------------------------------


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = shape.shapes(documents(spark, sf_dir, "doc_id", "text"))
    return kinds.filter("kind <> 'prose'").select("doc_id", "kind").distinct()


@query
def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.text_statistics(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", *(F.round(c, 6).alias(c) for c in shape.STATS))


# ---- 5: groups of posts and splits that keep them together -------------------------------------------


def _post_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "posts").select("post_id", "author", "source")
    return grouping.tied_groups(posts, "post_id", [account_key(F.col("author")), page_key(F.col("source"))])


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _post_groups(spark, sf_dir).filter("group_size > 1").select(F.col("rec_id").alias("post_id"), "group_id")


@query
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = materialize(_post_groups(spark, sf_dir))
    return grouping.group_splits(groups, {"train": 0.8, "validation": 0.1, "test": 0.1}).withColumnRenamed("rec_id", "post_id")


# ---- 6: language -------------------------------------------------------------------------------------


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.fit_model(docs, "text", "lang")
    found = language.document_languages(docs, model, label_col="lang")
    return found.filter("kind in ('prose', 'list')").select("doc_id", "lang").distinct()


@query
def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of sentences of one language in every document, with its words and confidence."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return language.segments(docs, language.fit_model(docs, "text", "lang")).withColumn("confidence", F.round("confidence", 6))


# ---- 7: reading level --------------------------------------------------------------------------------


def _reading_levels(spark: SparkSession, sf_dir: str, *bands: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.fit_model(docs, "text", "lang")
    papers = spread(table(spark, sf_dir, "papers"), "paper_id", "summary")
    cuts = reading.fit_bands(docs, table(spark, sf_dir, "labels"))
    of_docs = reading.reading_levels(docs, model, "doc_id", "text", bands, cuts).select(F.lit("documents").alias("tab"), "*")
    return of_docs.unionByName(reading.reading_levels(papers, model, "paper_id", "summary", bands, cuts).select(F.lit("papers").alias("tab"), "*"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _reading_levels(spark, sf_dir, "basic", "advanced")
    return levels.filter("english and running and sentences > 1").select("tab", "rec_id", "band").distinct()


@query
def p7_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts of both tables by whole grade."""
    levels = _reading_levels(spark, sf_dir, "basic", "middle", "advanced").filter("english").withColumn("grade", F.floor("grade").cast("long"))
    return levels.groupBy("tab", "grade").agg(F.count("*").alias("texts"), F.sum("words").alias("words"))


# ---- 8: leaked evaluation items ----------------------------------------------------------------------


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaked_items(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id").distinct()


@query
def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item that leaked: documents that hold it and the largest share of it found."""
    found = leaks.leaked_items(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), F.round(F.max("share"), 6).alias("most"))


# ---- 2: token budget ---------------------------------------------------------------------------------


@query
def p2_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.budget(documents(spark, sf_dir, "source", "lang", "topic", "format", "text"))


@query
def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir, "doc_id", "text"))


# ---- 9: mixing sources -------------------------------------------------------------------------------


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.reached_shares(mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"), targets), targets)


# ---- 10: truncated texts -----------------------------------------------------------------------------


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id").distinct()


@query
def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(documents(spark, sf_dir, "doc_id", "text", "source"))


# ---- 3: markup ---------------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = markup.clean_markup(documents(spark, sf_dir, "doc_id", "text"))
    return cleaned.select("doc_id", F.explode("kinds").alias("kind")).distinct()


@query
def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that carried markup, as clean text."""
    return markup.clean_markup(documents(spark, sf_dir, "doc_id", "text")).filter(F.size("kinds") > 0)
