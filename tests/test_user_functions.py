import pytest
from pyspark.sql import functions as F

from textquarry.operators import augmentation as A
from textquarry.operators.user_functions import Registry, filter_by, map_batches
from textquarry.sources.files import read_txt


def test_batches(docs):
    df = docs("a", "bb", "")
    up = map_batches(df, lambda p: p.assign(text=p["text"].str.upper()))
    assert {r.text for r in up.collect()} == {"A", "BB", ""}
    assert filter_by(df, lambda s: s.str.len() > 1).count() == 1
    assert map_batches(df.limit(0), lambda p: p).count() == 0


def test_registry(spark):
    r = Registry()
    r.register("upper", F.upper)
    assert spark.range(1).select(r.apply("upper", F.lit("x"))).first()[0] == "X" and r.names() == ["upper"]
    with pytest.raises(ValueError):
        r.apply("no", F.lit(1))


def test_composite(docs):
    df = docs("What is tea?", "It was good, because of the rain.", None)
    got = {r.doc_id: r.t for r in df.select("doc_id", A.composite_paraphrase(F.col("text"), "doc_id").alias("t")).collect()}
    assert "tea" in got[0] and got[0] != "What is tea?" and got[2] is None and "owing to" in got[1]


def test_other_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\n".encode("cp1252"))
    assert read_txt(spark, str(tmp_path / "a.txt"), "auto").first().text == "é"
