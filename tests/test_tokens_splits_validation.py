import json

import pytest
from pyspark.sql import functions as F

from textquarry.operators import splits as S
from textquarry.operators import tokenization as K
from textquarry.operators import validation as V


def test_tokenizer_round_trip(docs, tmp_path, spark):
    df = docs("The cat, the dog", "a cat", None)
    t = K.SimpleTokenizer(10)
    v = {r.token: r.id for r in t.train(df).collect()}
    assert v["<pad>"] == 0 and v["cat"] == 4 and v["the"] == 5
    ids = {r.doc_id: r.ids for r in t.encode(df).collect()}
    assert ids[2] is None and ids[0][0] == 5
    back = {r.doc_id: r.text for r in t.decode(t.encode(df)).collect()}
    assert back[0] == "the cat , the dog"
    t.save(str(tmp_path / "v"))
    assert K.SimpleTokenizer.load(spark, str(tmp_path / "v")).vocabulary.count() == t.vocabulary.count()


def test_small_vocabulary_knows_the_most_frequent(docs):
    df = docs("b b a a c")
    t = K.SimpleTokenizer(6)
    t.train(df)
    assert t.encode(df).first().ids == [5, 5, 4, 4, 1]
    with pytest.raises(ValueError):
        K.SimpleTokenizer().encode(df)
    with pytest.raises(ValueError):
        K.create_tokenizer("other")


def test_process_cuts(docs):
    p = K.process(docs("a b c", "a", None), K.SimpleTokenizer(), 2)
    assert {(r.doc_id, r.num_tokens, r.truncated) for r in p.collect()} == {(0, 2, True), (1, 1, False)}
    s = K.statistics(p).first()
    assert (s.texts, s.total_tokens, s.truncated) == (2, 3, 1)
    assert K.statistics(p.limit(0)).first().total_tokens == 0
    assert K.estimate_tokens(docs("a b", "c d"), K.SimpleTokenizer()) == 4


def test_split_sizes(spark):
    df = spark.range(7).withColumnRenamed("id", "doc_id")
    got = {r.split: r["count"] for r in S.random_split(df).groupBy("split").count().collect()}
    assert got == {"train": 5, "test": 2}
    again = S.random_split(df.repartition(3))
    assert S.random_split(df).exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        S.random_split(df, {"a": 0.5})


def test_stratified(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 90, F.lit("x")).alias("g"))
    got = {(r.g, r.split): r["count"] for r in S.stratified_split(df, "g").groupBy("g", "split").count().collect()}
    assert got[("x", "train")] == 72 and got[(None, "train")] == 8
    assert S.stratified_split(df.limit(0), "g").count() == 0


def test_sample_and_newest(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert S.sample(df, 10).count() == 10 and S.sample(df, 99).count() == 50
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert {(r.k, r.v) for r in S.newest(t, ["k"], "v", 1).collect()} == {("a", 2), ("b", 5)}
    assert S.newest(t, [], "v", 1).first().v == 5


def test_union_fills_missing(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, t string"), spark.createDataFrame([(2,)], "i int")
    assert {(r.i, r.t) for r in S.union_all(a, b).collect()} == {(1, "x"), (2, None)}


def test_validation(spark):
    df = spark.createDataFrame([(1, "fine"), (2, " "), (3, "a\x00"), (4, None), (5, "x" * 10001)], "doc_id long, text string")
    v = V.validate(df, ["doc_id", "text", "url"])
    got = {r.error: r["count"] for r in V.error_summary(v).collect()}
    assert got == {"Missing required field": 5, "Empty text field": 1, "Control characters in field": 1, "Required field is None": 1, "Very long lines in field": 1}
    assert V.validity(V.validate(df)).first().valid == 2


def test_upper_median(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("dddd",), (None,)], "t string")
    r = V.field_statistics(df).first()
    assert (r.present, r.min_length, r.max_length, r.median_length, r.avg_length) == (4, 1, 4, 3, 2.5)


def test_schema_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "x" * 50)], "doc_id long, text string")
    schema = V.create_schema(df)
    assert schema["properties"]["doc_id"]["type"] == "integer" and schema["properties"]["text"]["type"] == ["string", "null"]
    assert df.filter(F.size(V.schema_errors(df, {"required": ["text"], "properties": {"text": {"type": "string", "maxLength": 10}}})) > 0).count() == 2
    report = V.comprehensive(df)
    assert report["documents"] == 3 and 0 <= report["quality_score"] <= 1
    V.export_report(report, str(tmp_path / "r.json"))
    assert json.load(open(tmp_path / "r.json"))["documents"] == 3
    with pytest.raises(ValueError):
        V.export_report(report, str(tmp_path / "r"), "pdf")
    assert V.comprehensive(df.limit(0))["documents"] == 0
