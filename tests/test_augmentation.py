from pyspark.sql import functions as F

from textquarry.operators import augmentation as A
from textquarry.operators import synthetic as Y


def test_synonyms_keep_capitals_and_signs(docs):
    df = docs("Good, he said.", "nothing fits", None)
    got = {r.doc_id: r.t for r in df.select("doc_id", A.replace_synonyms(F.col("text"), "doc_id").alias("t")).collect()}
    assert got[0] in ("Fine, he said.", "Sound, he said.") and got[1] == "nothing fits" and got[2] is None


def test_phrases(spark):
    t = spark.range(1).select(A.transform_phrases(F.lit("In order to go, as well as stay"))).first()[0]
    assert t == "to go, and also stay"


def test_restructure():
    assert A.restructure("The book was written by Ann") == "Ann wrote the book"
    assert A.restructure("we left because it rained") == "It rained because we left"
    assert A.restructure("nothing here") == "nothing here"


def test_templates():
    assert A.template_paraphrase("What is tea?", 0) == "Could you explain tea?"
    assert A.template_paraphrase("please wait.", 1) == "Kindly wait."
    assert A.template_paraphrase("tea", 0) is None


def test_paraphrases_repeat_by_seed(docs):
    df = docs("A good and important plan, because of the rain.", None)
    a, b = A.paraphrases(df, seed=3), A.paraphrases(df.repartition(2), seed=3)
    assert a.select("doc_id", "text").exceptAll(b.select("doc_id", "text")).count() == 0
    assert a.filter("not is_paraphrase").count() == 2 and a.filter("is_paraphrase and original_id is null").count() == 0
    assert A.paraphrases(df.limit(0)).count() == 0


def test_back_translations(docs):
    df = docs("I don't think it is in the house.", "We got a new book.", "Third text.", None)
    out = A.back_translations(df, 0.5, 2, advanced=True)
    assert out.filter("is_back_translation").count() == 4 and out.count() == 8
    s = A.statistics(out, "is_back_translation").first()
    assert (s.original, s.augmented, s.ratio) == (4, 4, 1.0)
    assert A.back_translations(df, 0.5, 0).count() == 4


def test_synthetic(spark):
    assert Y.texts(spark, 20).filter("text like '%{%' or text is null").count() == 0
    pair = Y.instructions(spark, 5).first()
    assert pair.instruction and "topic" in pair.variables
    talk = Y.conversations(spark, 3).first().conversation
    assert len(talk) == 6 and talk[0].turn_number == 1
    counts = {r.kind: r["count"] for r in Y.statistics(Y.mixed(spark, 10, {"text": 2, "instruction": 1, "conversation": 1})).collect()}
    assert counts == {"text": 5, "instruction": 2, "conversation": 2}
    assert Y.as_documents(Y.instructions(spark, 1)).first().text.startswith("Instruction: ")
