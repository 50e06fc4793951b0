"""Queries of sources, sinks, augmentation, synthetic data, monitoring and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import augmentation as A
from textquarry.operators import splits
from textquarry.operators import synthetic as Y
from textquarry.plans import versioning
from textquarry.registry import SQL, query
from textquarry.runtime import ensure_checkpoint_dir, table
from textquarry.sources import api, datasets, files, sinks, web
from textquarry.streaming import monitoring as MON


def _shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks -------------------------------------------------------------------------------


@query
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with text as documents."""
    d = web.page_documents(table(spark, sf_dir, "pages"))
    return d.select("source", "title", F.length("text").cast("long").alias("chars"), F.try_element_at("metadata", F.lit("content_type")).alias("content_type"))


SQL["page_documents"] = "select url as source, title, length(text) as chars, content_type from pages where text is not null and trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''"


@query
def filtered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.filter_pages(table(spark, sf_dir, "pages"), 200, ("cookie", "subscribe")).select("page_id")


SQL["filtered_pages"] = "select page_id from pages where length(text) >= 200 and not regexp_matches(text, '(?i)cookie') and not regexp_matches(text, '(?i)subscribe')"


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets by the pages that point to them."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode("links").alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


SQL["page_links"] = "select target, count(*) as links, count(distinct page_id) as pages from (select page_id, unnest(links) as target from pages) group by target"


@query
def paper_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprints as documents: the summary is the text."""
    d = api.documents(table(spark, sf_dir, "papers").select("title", "summary", "source", "url"))
    return d.select("title", "source", F.length("text").cast("long").alias("chars"), F.get_json_object("metadata", "$.url").alias("url"))


SQL["paper_documents"] = "select title, source, length(summary) as chars, url from papers where trim(summary) <> ''"


@query
def paper_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "papers").select("paper_id", F.explode("authors").alias("author"))
    return a.groupBy("author").agg(F.count_distinct("paper_id").alias("papers"))


SQL["paper_authors"] = "select author, count(distinct paper_id) as papers from (select paper_id, unnest(authors) as author from papers) group by author"


@query
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of file records and how many records have a value."""
    f = table(spark, sf_dir, "file_records").select(F.lower(F.trim("format")).alias("format"), F.explode("content").alias("field", "value"))
    return f.groupBy("format", "field").agg(F.count("*").alias("records"), F.count("value").alias("with_value"))


SQL["record_fields"] = "select lower(trim(format)) as format, e.key as field, count(*) as records, count(e.value) as with_value from (select format, unnest(map_entries(content)) as e from file_records) group by 1, 2"


@query
def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of file records promoted to text."""
    d = files.promote_text(table(spark, sf_dir, "file_records"), "body")
    return d.filter("text is not null").select("record_id", F.length("text").cast("long").alias("chars"))


SQL["record_texts"] = "select record_id, length(content['body']) as chars from file_records where content['body'] is not null"


@query
def post_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivery of every post."""
    p = table(spark, sf_dir, "posts")
    return p.groupBy("post_id").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("score", F.struct("fetched_at", F.coalesce("score", F.lit(-1)))).alias("score"), F.count("*").alias("deliveries")).select("post_id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "score", "deliveries")


SQL["post_versions"] = "select post_id, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') as fetched_at, (list(score order by fetched_at desc, coalesce(score, -1) desc))[1] as score, count(*) as deliveries from posts group by post_id"


@query
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and topics written as CSV and read as records with their columns."""
    path = _shared(spark, "csv")
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("title", "[\r\n]+", " ").alias("title"), "topic")
    d.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    r = files.read_csv(spark, f"{path}/part-*")
    return r.select("content.doc_id", "format", F.sha2(F.coalesce("content.title", F.lit("")), 256).alias("title"), F.coalesce("content.topic", F.lit("")).alias("topic"))


SQL["csv_rows"] = "select doc_id::int as doc_id, 'csv' as format, sha256(coalesce(regexp_replace(title, '[\r\n]+', ' ', 'g'), '')) as title, coalesce(topic, '') as topic from documents"


@query
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written to plain files and read line by line: stripped lines that are not blank, how often each."""
    path = _shared(spark, "lines")
    table(spark, sf_dir, "documents").filter("text is not null").select("text").write.text(path)
    lines = files.read_txt(spark, f"{path}/part-*").select(F.sha2("text", 256).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("times"))


_BLANK_SQL = T.BLANK.replace("\\t", "\t").replace("\\n", "\n").replace("\\f", "\f").replace("\\r", "\r")
SQL["text_lines"] = f"""with l as (select unnest(regexp_split_to_array(text, '\r\n|\r|\n')) as x from documents where text is not null), s as (select regexp_replace(x, '^{_BLANK_SQL}+|{_BLANK_SQL}+$', '', 'g') as x from l)
select sha256(x) as line, count(*) as times from s where x <> '' group by 1"""


@query
def parquet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a Parquet file as records, with the file they come from."""
    r = files.read_parquet(spark, f"{sf_dir}/papers.parquet", ["paper_id", "title"])
    return r.select("content.paper_id", "content.title", "format", F.col("source").contains("papers.parquet").cast("int").alias("from_papers"))


SQL["parquet_rows"] = "select paper_id, title, 'parquet' as format, 1 as from_papers from papers"


@query
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table, the same rows in another order, and a changed one as versions: rows that only one of them has."""
    tracker = versioning.DatasetTracker(spark, _shared(spark, "versions"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    a = tracker.create(d, "labels")
    same = tracker.create(d.repartition(3, "lang"), "again")
    b = tracker.create(d.withColumn("lang", F.lower("lang")), "lower")
    told = tracker.compare(a, b, rows=True)
    row = (len(tracker.versions), int(a == same), tracker.get(a).documents, told["document_difference"], told["only_in_first"], told["only_in_second"])
    return spark.createDataFrame([row], "versions long, same int, documents long, difference long, only_in_first long, only_in_second long")


SQL["version_changes"] = "select 2::bigint as versions, 1 as same, count(*) as documents, 0::bigint as difference, count(*) filter (where lower(lang) <> lang) as only_in_first, count(*) filter (where lower(lang) <> lang) as only_in_second from documents"


@query
def split_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as a dataset with splits, written, and read again split by split."""
    path = _shared(spark, "dataset")
    d = splits.random_split(table(spark, sf_dir, "papers").select("paper_id", "title"), {"train": 0.75, "test": 0.25}, "paper_id")
    sinks.write_splits(d, path, "dataset")
    parts = [datasets.load(spark, path, name).groupBy("split").agg(F.count("*").alias("rows"), F.sum("paper_id").alias("ids")) for name in ("train", "test")]
    return parts[0].unionByName(parts[1])


SQL["split_dataset"] = """with r as (select paper_id, row_number() over (order by sha256('42:' || paper_id), paper_id) as k, count(*) over () as n from papers)
select case when k <= floor(n * 0.75 + 1e-9) then 'train' else 'test' end as split, count(*) as rows, sum(paper_id)::bigint as ids from r group by 1"""


@query
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines with a mapping and read again."""
    path = _shared(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "documents"), path, {"id": "doc_id", "body": "text", "origin": "source"})
    d = sinks.read_jsonl(spark, path, schema=spark.createDataFrame([], "id long, body string, origin string").schema)
    return d.select("id", F.sha2("body", 256).alias("digest"), "origin")


SQL["jsonl_round_trip"] = "select doc_id as id, sha256(text) as digest, source as origin from documents"


@query
def parquet_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by type and read back with a condition on the partition."""
    path = _shared(spark, "parquet")
    sinks.write_parquet(table(spark, sf_dir, "events"), path, partition_by=["event_type"], optimize=True)
    return sinks.read_parquet(spark, path).groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


SQL["parquet_partitions"] = "select event_type, count(*) as events, count(distinct user_id) as users from events group by event_type"


@query
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards of 300 orders."""
    path = _shared(spark, "shards")
    sinks.write_shards(table(spark, sf_dir, "orders").select("o_orderkey"), path, 300, "o_orderkey")
    return spark.read.json(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


SQL["shard_sizes"] = "select (r // 300)::bigint as shard, count(*) as orders, min(o_orderkey) as first, max(o_orderkey) as last from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r from orders) group by 1"


@query
def line_items_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned scan, condition pushed to the file, partial sums before the shuffle."""
    li = sinks.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_shipdate", "l_quantity", "l_returnflag"], "l_quantity >= 10")
    return li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag").agg(F.count("*").alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


SQL["line_items_by_month"] = "select strftime(l_shipdate, '%Y-%m') as month, l_returnflag, count(*) as items, round(sum(l_quantity), 2) as quantity from lineitem where l_quantity >= 10 group by 1, 2"


# ---- augmentation and synthetic data -----------------------------------------------------------------


@query
def phrase_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", A.transform_phrases(F.col("text")).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("digest"))


def _phrases_sql() -> str:
    out = "text"
    for old, new in A.PHRASES:
        out = rf"regexp_replace({out}, '(?i)\b{old}\b', '{new}', 'g')"
    return out


SQL["phrase_transform"] = f"select doc_id, sha256({_phrases_sql()}) as digest from documents where text is not null"


@query
def paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paraphrases(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "is_paraphrase", "original_id", F.length("text").alias("chars"))


@query
def back_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.back_translations(table(spark, sf_dir, "documents").select("doc_id", "text"), advanced=True)
    return A.statistics(d, "is_back_translation")


@query
def synthetic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 synthetic rows by kind."""
    return Y.statistics(Y.mixed(spark, 1000))


SQL["synthetic_mix"] = "select kind, count::bigint as count from (values ('text', 400), ('instruction', 400), ('conversation', 200)) v(kind, count)"


# ---- monitoring and streams --------------------------------------------------------------------------


@query
def metric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = MON.metric_statistics(table(spark, sf_dir, "events"), "event_type")
    return s.select("name", "count", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "latest", "median")))


SQL["metric_statistics"] = "select event_type as name, count(value) as count, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, round((list(value order by ts desc, value desc))[1], 6) as latest, round(median(value), 6) as median from events group by event_type"


@query
def metric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = MON.windowed(table(spark, sf_dir, "events"), "1 day", name_col="event_type")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "name", "count", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("sum", 4).alias("sum"))


SQL["metric_windows"] = "select strftime(ts, '%Y-%m-%d') as day, event_type as name, count(*) as count, round(min(value), 6) as min, round(max(value), 6) as max, round(sum(value), 4) as sum from events group by 1, 2"


@query
def metric_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics whose latest value is above 10."""
    stats = MON.metric_statistics(table(spark, sf_dir, "events"), "event_type")
    names = [r.name for r in stats.select("name").collect()]  # kinds of events, a handful
    return MON.alerts(stats, [MON.Rule(f"high_{n}", n, "gt", 10.0) for n in names]).withColumn("value", F.round("value", 6))


SQL["metric_alerts"] = "select 'high_' || event_type as rule, event_type as metric, round((list(value order by ts desc, value desc))[1], 6) as value, 10.0::double as threshold from events group by event_type having (list(value order by ts desc, value desc))[1] > 10"


@query
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that a pause of 30 minutes ends."""
    s = MON.sessions(table(spark, sf_dir, "events"), "user_id")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


SQL["user_sessions"] = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g), c as (select user_id, s, count(*) as n from s group by 1, 2)
select user_id, count(*) as sessions, max(n) as longest from c group by user_id"""


@query
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of metric_windows over the same rows as a stream, written batch by batch to the shared folder."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(source if _is_folder(source) else sf_dir + "/event*.parquet")
    out = _shared(spark, "stream")
    w = MON.windowed(stream, "1 day", name_col="event_type")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = w.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", _shared(spark, "stream-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    d = spark.read.parquet(out)
    return d.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "name", "count", F.round("sum", 4).alias("sum"))


def _is_folder(path: str) -> bool:
    import os

    return os.path.isdir(path)


SQL["streamed_windows"] = "select strftime(ts, '%Y-%m-%d') as day, event_type as name, count(*) as count, round(sum(value), 4) as sum from events group by 1, 2"
