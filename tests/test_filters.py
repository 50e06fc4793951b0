import pytest
from pyspark.sql import functions as F

from textquarry.operators import filters as FL


def test_null_text_passes(docs):
    df = docs("one two three", None, "x")
    assert {r.doc_id for r in FL.length_filter(2, unit="words").apply(df).collect()} == {0, 1}


def test_sentences_count_the_empty_tail(spark):
    assert spark.range(1).select(FL.size_of(F.lit("A. B."), "sentences")).first()[0] == 3
    with pytest.raises(ValueError):
        FL.size_of(F.lit(""), "lines")


def test_toxicity(docs):
    df = docs("hate and violence", "a good day", "...")
    assert [round(r.t, 3) for r in df.orderBy("doc_id").select(FL.toxicity(F.col("text")).alias("t")).collect()] == [0.667, 0, 0]
    assert FL.toxicity_filter().apply(df).count() == 2


def test_content_type_first_match_wins(docs):
    df = docs("A recipe reported in the news", "how to", "nothing here")
    assert [r.type for r in df.orderBy("doc_id").select(FL.content_type(F.col("text"))["type"].alias("type")).collect()] == ["recipe", "tutorial", "general"]
    assert FL.content_type_filter(["general"]).apply(df).count() == 0


def test_pipeline_telescopes(docs):
    df = docs("hate", "a long enough text", "hate " * 20, None)
    p = FL.FilterPipeline().add_filter(FL.length_filter(5)).add_filter(FL.toxicity_filter())
    rows = p.statistics(df).orderBy("step").collect()
    assert [(r.original, r.filtered) for r in rows] == [(4, 3), (3, 2)]
    assert p.process(df).count() == 2
    assert FL.FilterPipeline([]).process(df).count() == 4


def test_composite(docs):
    df = docs("hate", "a long enough text")
    fs = [FL.length_filter(5), FL.toxicity_filter()]
    assert FL.composite(fs, "and").apply(df).count() == 1 and FL.composite(fs, "or").apply(df).count() == 1
    assert FL.composite([]).apply(df).count() == 2
    assert {r["filter"]: r.filtered for r in FL.composite_statistics(df, fs).collect()} == {"length_characters": 1, "toxicity": 1, "and": 1}
    with pytest.raises(ValueError):
        FL.composite(fs, "xor")


def test_scoring_filters_keep_null(docs):
    df = docs("The cat sat. The dog ran!", None, "zzzz")
    assert {r.doc_id for r in FL.quality_filter(df, 0.6).collect()} == {0, 1}
    assert {r.doc_id for r in FL.perplexity_filter(df, 4.0).collect()} == {1, 2}
    assert FL.language_filter(["en"]).apply(df).count() == 3


def test_duplicate_filter(docs):
    df = docs("a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i", "x y", None)
    assert {r.doc_id for r in FL.duplicate_filter(df, 0.9).collect()} == {0, 3, 4}
