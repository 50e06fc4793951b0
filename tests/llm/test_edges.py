"""Nulls, empty, blank and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from textquarry.llm import encoding, language, leaks, markup, mixing, reading, shape, tokens, truncation

LONG = "The quick reader found a sentence that went on and on. " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "en", None, None, None), (2, "", "xx", "", "", ""), (3, " \n\t", None, "s", "t", "f"), (4, LONG, "en", "s", "t", "f"), (5, "x", "en", "s", "t", "f"),
        (5, "x", "en", "s", "t", "f"), (None, "An id is missing here. It is so.", "en", "S ", "News", ".TXT"), (6, "\ud7ff￿ \x00 {{{[[[<<<&&&$$$ ```", "de", "s", "t", "f"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, format string")
    for clash in ("kind", "kinds", "clean", "rec_id", "band", "share", "tokens", "words", "_id", "_text", "damaged", "copies", "w1", "ending"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def model():
    return language.train([])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Which of the four bridges over the northern river was closed first"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")


def operators(spark, model, items):
    return {
        "repair": lambda d: encoding.repair_texts(d, "doc_id", "text"),
        "tokens": lambda d: tokens.token_counts(d),
        "budget": lambda d: tokens.budget(d),
        "markup": lambda d: markup.clean_markup(d),
        "statistics": lambda d: shape.text_statistics(d),
        "shapes": lambda d: shape.shapes(d),
        "languages": lambda d: language.document_languages(d, model, label_col="lang"),
        "segments": lambda d: language.segments(d, model),
        "reading": lambda d: reading.reading_levels(d, model, "doc_id", "text"),
        "leaks": lambda d: leaks.leaked_items(d, items),
        "mix": lambda d: mixing.mix(d, spark.createDataFrame([("s", 0.5, 2), ("none", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")),
        "unfinished": lambda d: truncation.unfinished(d),
        "rates": lambda d: truncation.rates(d),
    }


NAMES = ("repair", "tokens", "budget", "markup", "statistics", "shapes", "languages", "segments", "reading", "leaks", "mix", "unfinished", "rates")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_none(spark, odd, model, items, name):
    f = operators(spark, model, items)[name]
    f(odd).collect()
    assert f(odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["tokens", "markup", "statistics"])
def test_repeated_rows_repeat(spark, odd, model, items, name):
    got = operators(spark, model, items)[name](odd)
    assert got.count() == odd.count() and got.filter("doc_id = 5").count() == 2


def test_null_text_has_defined_results(odd):
    assert tokens.token_counts(odd).filter("doc_id = 1").first().tokens is None
    assert tokens.token_counts(odd).filter("doc_id = 2").first().tokens == 0
    r = markup.clean_markup(odd).filter("doc_id = 1").first()
    assert r.kinds == [] and r.clean is None
    assert {r.kind for r in shape.shapes(odd).filter("doc_id in (1, 2, 3)").collect()} == {None}
