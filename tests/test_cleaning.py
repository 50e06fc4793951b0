from pyspark.sql import functions as F

from textquarry.functions import cleaning as C
from textquarry.functions.language import detect_language, is_language


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_steps(spark):
    assert value(spark, C.remove_urls, "see http://a.io/x?q=1#frag ~ now") == "see #frag ~ now"
    assert value(spark, C.remove_emails, "mail a.b+c@x.co.uk now") == "mail  now"
    assert value(spark, C.collapse_blanks, "a\xa0b\t\nc ") == "a b c"
    assert value(spark, C.remove_control, "a\x00b\x1fc\n") == "abc\n"
    assert value(spark, C.clean_html, "&lt;b&gt;x&lt;/b&gt; <script>y</script>z") == "x z"
    assert value(spark, C.fix_encoding, "cafÃ© dâ€™Ã©tÃ©") == "café d’été"
    assert value(spark, C.fix_encoding, "SÃO PAULO") == "SÃO PAULO"
    assert value(spark, C.normal_form, "ﬁn Ａ") == "fin A"


def test_chain_and_bounds(spark):
    df = spark.createDataFrame([(1, " <p>Hello  world</p> "), (2, "x"), (3, None)], "doc_id long, text string")
    out = C.TextCleaner(min_length=3).clean(df).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, "Hello world")]
    assert C.TextCleaner(max_length=5).clean(df.limit(0)).count() == 0


def test_custom_patterns_take_python_references(spark):
    c = C.TextCleaner(custom_patterns={r"(\d+) USD": r"$\1"})
    assert value(spark, c.expression, "12 USD") == "$12"


def test_statistics(spark):
    df = spark.createDataFrame([("ab  cd",), ("",), (None,)], "text string")
    r = C.TextCleaner(min_length=1).statistics(df).first()
    assert (r.texts, r.kept, r.chars_before, r.chars_after) == (2, 1, 6, 5)
    assert C.TextCleaner().statistics(df.limit(0)).first().texts == 0


def test_language(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat and it was happy with the weather of that day."), (2, "Der Hund lag auf dem Teppich und die Katze war nicht im Haus, weil das Wetter gut war."), (3, "short"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.d for r in df.select("doc_id", detect_language(F.col("text")).alias("d")).collect()}
    assert got == {1: "en", 2: "de", 3: None, 4: None}
    assert df.filter(is_language(F.col("text"), ["en"])).count() == 1
