import math
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textquarry.functions import metrics as M

CAT = "The cat sat. The dog ran!"


def one(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return M.all_metrics(df).first()


def test_hand_values(spark):
    r = one(spark, CAT)
    assert r.word_count == 6 and r.sentence_count == 3
    assert r.flesch_reading_ease == 100.0 and r.flesch_kincaid_grade == 0.0
    assert r.vocabulary_richness == pytest.approx(5 / 6) and r.bigram_diversity == 1.0
    assert r.repetitiveness == pytest.approx(0.030276100131752748, abs=1e-9)
    assert (r.spelling_error_ratio, r.punctuation_quality) == (0.0, 1.0)
    assert r.coherence == pytest.approx(0.2) and r.quality_score == pytest.approx(0.7236390566534914, abs=1e-9)


def test_perplexity(spark):
    m = M.measured(spark.createDataFrame([(1, CAT), (2, "...")], "doc_id long, text string")).select("doc_id", M.perplexity().alias("p"))
    got = {r.doc_id: r.p for r in m.collect()}
    assert got[1] == pytest.approx(4.762203155904597, abs=1e-9) and got[2] == math.inf


@pytest.mark.parametrize(("word", "n"), [("queue", 1), ("the", 1), ("table", 1), ("rhythm", 1), ("area", 2), ("make", 1), ("banana", 3)])
def test_syllables(spark, word, n):
    assert spark.range(1).select(M.syllables(F.lit(word))).first()[0] == n


def test_blank_text_is_all_zero(spark):
    r = one(spark, " \n ").asDict()
    assert all(v == 0 for k, v in r.items() if k != "doc_id")


def test_against_plain_python(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist() if r["text"]}
    m = M.measured(spark.read.parquet(path)).select("doc_id", "n_words", "n_syllables", M.repetitiveness().alias("rep"), M.ngram_diversity(3).alias("tri"), M.coherence().alias("coh"))
    for r in m.collect():
        if r.doc_id not in texts:
            continue
        w = [x.lower() for x in re.findall(r"\b\w+\b", texts[r.doc_id])]
        assert r.n_words == len(w)
        syl = 0
        for x in w:
            k = len(re.findall("[aeiouy]+", x))
            syl += max(1, k - (x.endswith("e") and k > 1))
        assert r.n_syllables == syl
        if len(w) >= 3:
            grams = list(zip(w, w[1:], w[2:], strict=False))
            assert r.tri == pytest.approx(len(set(grams)) / len(grams))
        c = Counter(w)
        if len(c) > 1:
            h = -sum(n / len(w) * math.log2(n / len(w)) for n in c.values())
            assert r.rep == pytest.approx(min(1, max(0, 1 - h / math.log2(len(c)))), abs=1e-9)


def test_lexical_diversity_needs_fifty_words(spark):
    df = spark.createDataFrame([(1, "word " * 49), (2, " ".join(f"w{i}" for i in range(60))), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.m for r in df.select("doc_id", M.lexical_diversity("text").alias("m")).collect()}
    assert got[1] == 0 and got[2] == 60 and got[3] == 0
