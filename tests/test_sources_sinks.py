import gzip
import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions import html as H
from textquarry.runtime import ensure_checkpoint_dir
from textquarry.sources import api, files, sinks, web


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one", "source": "own", "n": 1}\n\n{broken\n{"text": "two"}\n', encoding="utf-8")
    (tmp_path / "b.txt").write_text(" first \r\n\n second\n", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"text": "whole", "k": [1, 2]}', encoding="utf-8")
    (tmp_path / "d.csv").write_text('text,n\n"a, b",1\nc,2\n', encoding="utf-8")
    (tmp_path / "e.xml").write_text('<r><text lang="en">x</text><g><text>y</text><text/></g></r>', encoding="utf-8")
    (tmp_path / "f.xml").write_text("<r><text>", encoding="utf-8")
    (tmp_path / "g.bin").write_bytes(b"\xff\xe9")
    return tmp_path


def test_readers(spark, folder):
    rows = {r.text: r for r in files.read_file(spark, str(folder / "a.jsonl")).collect()}
    assert set(rows) == {"one", "two"} and rows["one"].source.endswith("a.jsonl") and rows["one"].format == "jsonl"
    assert files.read_jsonl(spark, str(folder / "a.jsonl"), malformed=True).count() == 1
    assert [(r.text, r.line_number) for r in files.read_txt(spark, str(folder / "b.txt")).orderBy("line_number").collect()] == [("first", 1), ("second", 3)]
    assert files.promote_text(files.read_json(spark, str(folder / "c.json"))).first().text == "whole"
    assert {r.content.text for r in files.read_csv(spark, str(folder / "d.csv")).collect()} == {"a, b", "c"}
    assert [(r.text, r.attributes) for r in files.read_xml(spark, str(folder / "e.xml")).orderBy("text").collect()] == [("x", {"lang": "en"}), ("y", {})]
    assert files.read_xml(spark, str(folder / "f.xml")).count() == 0


def test_dispatch(spark, folder):
    with pytest.raises(ValueError):
        files.read_file(spark, str(folder / "g.bin"))
    with pytest.raises(FileNotFoundError):
        files.read_file(spark, str(folder / "no.txt"))
    got = files.read_directory(spark, str(folder))
    assert got.filter("text is not null").count() == 2 + 2 + 1 + 2 + 2
    assert files.read_directory(spark, str(folder), "*.nothing") is None
    assert {r.name: r.encoding for r in files.file_metadata(spark, str(folder)).collect()}["g.bin"] == "cp1252"


def test_html():
    page = H.read("<head><title> T </title><meta name=description content=d></head><header>H</header><p>x  y<script>z</script></p><a href='/k'>l</a><a href=/k>l</a>", "http://a.example/")
    assert page.title.strip() == "T" and page.links == ["http://a.example/k"] * 2 and page.meta["description"] == "d"
    assert page.text() == "T x yll"


def test_web(spark, tmp_path):
    (tmp_path / "p.html").write_text("<html><title>T</title> <p>body text</p></html>", encoding="utf-8")
    spark.dataSource.register(web.WebSource)
    got = spark.read.format("web").option("urls", f"file://{tmp_path}/p.html file://{tmp_path}/missing.html").option("delay", 0).load()
    rows = {r.url.rpartition("/")[2]: r for r in web.parse_pages(got, with_links=True).collect()}
    assert rows["p.html"].title == "T" and rows["p.html"].text == "T body text"
    assert rows["missing.html"].error and rows["missing.html"].text is None
    assert web.page_documents(web.parse_pages(got)).count() == 1
    xml = spark.createDataFrame([("<urlset><url><loc> http://a/?x=1&amp;y </loc></url><url><loc>b</loc></url></urlset>",)], "body string")
    assert [r.url for r in web.sitemap_urls(xml).collect()] == ["http://a/?x=1&y", "b"]


def test_api_payloads(spark):
    def df(x):
        return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),)], "payload string")

    hits = api.news_board(df({"hits": [{"objectID": "1", "story_text": "", "comment_text": "c", "points": 3}]})).first()
    assert (hits.text, hits.score) == ("c", 3)
    assert api.forum(df({"data": {"children": [{"data": {"id": "a", "selftext": "t", "created_utc": 0.0}}]}})).first().text == "t"
    assert api.crawl_index(df('{"url": "u"}\nbroken\n')).count() == 1
    assert api.encyclopedia(df({"title": "T", "extract": "E", "content_urls": {"desktop": {"page": "p"}}})).first().url == "p"
    entry = api.preprints(df("<feed><entry><title>A\n B</title><summary>s &lt; t</summary><author><name>X</name></author><author><name>Y</name></author></entry></feed>")).first()
    assert (entry.title, entry.abstract, entry.authors) == ("A B", "s < t", ["X", "Y"])
    rss = api.feed(df("<rss><item><title>a</title><description>d</description><link>l</link><pubDate>p</pubDate></item><item><title>b</title></item></rss>"), limit=1).collect()
    assert len(rss) == 1 and (rss[0].description, rss[0].link, rss[0].published) == ("d", "l", "p")
    assert api.feed(df('<feed><entry ><title>e</title><link href="x"/></entry></feed>')).first().link == "x"
    assert api.documents(spark.createDataFrame([("T", "body", "u")], "title string, abstract string, url string")).first().text == "body"


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None, (("x", 2),)), (2, None, "s", None)], "id long, text string, source string, meta struct<inner: struct<a: string, b: int>>")
    path = str(tmp_path / "out")
    sinks.write_jsonl(df, path, {"i": "id", "a": "meta.inner.a", "none": "meta.no"}, "gzip")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.gz") for x in gzip.open(f, "rt", encoding="utf-8")]
    assert sorted(lines, key=lambda x: x["i"]) == [{"i": 1, "a": "x"}, {"i": 2}]
    assert sinks.read_jsonl(spark, path, limit=1).count() == 1 and sinks.read_jsonl(spark, path, limit=0).count() == 2
    with pytest.raises(ValueError):
        sinks.write_jsonl(df, path, compression="bz9")
    (tmp_path / "v.jsonl").write_text('{"a": 1}\n\nx{\n', encoding="utf-8")
    v = sinks.validate_jsonl(spark, str(tmp_path / "v.jsonl")).first()
    assert (v.total_lines, v.valid_lines, v.empty_lines, v.invalid_lines, v.valid) == (3, 1, 1, 1, False)


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, 300, "a", [1]), (2, -5, "b", None)], "id long, n long, k string, xs array<int>")
    sinks.write_parquet(df, str(tmp_path / "p"), partition_by=["k"], optimize=True, as_strings=True)
    back = sinks.read_parquet(spark, str(tmp_path / "p"), ["id", "n", "xs"], "k = 'a'")
    assert dict(back.dtypes) == {"id": "tinyint", "n": "smallint", "xs": "string"} and back.first().xs == "[1]"
    with pytest.raises(ValueError):
        sinks.write_parquet(df, str(tmp_path / "q"), partition_by=["zz"])
    sinks.merge_parquet(spark, [str(tmp_path / "p"), str(tmp_path / "none")], str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2 and sinks.schema_info(df)["rows"] == 2
    with pytest.raises(ValueError):
        sinks.merge_parquet(spark, [str(tmp_path / "none")], str(tmp_path / "m2"))


def test_shards_and_splits(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "doc_id")
    sinks.write_shards(df, str(tmp_path / "s"), 10)
    got = {r.shard: (r.n, r.a) for r in spark.read.json(str(tmp_path / "s")).groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("a")).collect()}
    assert got == {0: (10, 0), 1: (10, 10), 2: (5, 20)}
    with pytest.raises(ValueError):
        sinks.write_shards(df, str(tmp_path / "s"), 0)
    sinks.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "d"), "dataset")
    assert json.load(open(tmp_path / "d" / "dataset_info.json"))["total"] == 25
    w = sinks.BatchWriter(str(tmp_path / "b"))
    w.add(df)
    w.add(df)
    assert spark.read.json(str(tmp_path / "b")).count() == 50


def test_checkpoints_go_where_the_session_says(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
