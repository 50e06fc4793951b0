"""Counts against plain Python, and groups that hold a third of all rows."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.llm import mixing, tokens, truncation

TEXTS = ["The cat sat. The cat ran off!\nthe dog's bone", "Нет, не так? Да", "a", "", "one two three four. one two three five", None, "x\n\ny"]


def counted(texts):
    inside, ends = Counter(), Counter()
    for t in texts:
        if t is None:
            continue
        a = [".", ".", *re.findall(r"[^\W_]+(?:['’-][^\W_]+)*|[.!?\n]", t.lower())]
        mark = set(".!?\n")
        for i in range(2, len(a) - 1):
            if a[i] in mark:
                continue
            w2 = "¶" if a[i - 1] in mark else a[i - 1]
            w1 = "¶" if a[i - 1] in mark or a[i - 2] in mark else a[i - 2]
            (ends if a[i + 1] in mark else inside)[w1, w2, a[i]] += 1
    return {k: (inside[k], ends[k]) for k in inside.keys() | ends.keys()}


def test_trigrams(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    want = counted(TEXTS)
    got = {(r.w1, r.w2, r.w3): (r.inside, r.ends) for r in truncation._run(spark, truncation.TRIGRAMS, docs=df).collect()}
    assert {k: v for k, v in got.items() if k[1] == "¶" or k[0] != "¶"} == {k: v for k, v in want.items() if k[1] == "¶" or k[0] != "¶"}
    assert sum(a + b for a, b in got.values()) == sum(a + b for a, b in want.values())


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files here")
def test_one_text_in_a_third_of_the_rows(spark):
    same = F.when(F.col("id") % 3 == 0, F.lit("the same words again")).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string")))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), same.alias("text"), F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"))
    goals = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    shares = {r.source: r.share for r in mixing.reached_shares(mixing.mix(df, goals), goals).collect()}
    assert abs(shares["a"] - 0.8) < 0.001 and abs(shares["b"] - 0.2) < 0.001
