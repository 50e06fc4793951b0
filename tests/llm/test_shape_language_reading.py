import numpy as np
import pytest

from textquarry.llm import language, reading, shape

PROSE = "We walked along the river for an hour before it began to rain. Nobody had brought a coat, so we waited under the bridge."


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("prose", PROSE), ("prose", "the old mill was closed for the winter and nobody knew why\nwe asked the owner about it after the meeting was over"), ("prose", "Take these:\n- milk\n- bread\n" + PROSE),
        ("list", "- milk\n- bread\n- two apples\n- some tea"), ("list", "the milk\nthe bread\ntwo apples\nsome tea\nfive eggs"), ("list", "(1) milk\n(2) bread\n(3) tea"), ("list", "<ul><li>the milk</li><li>bread</li><li>some tea</li></ul>"), ("list", "the milk; two apples; some tea; the bread\nfive eggs; a jar of honey; the flour"),
        ("table", "a\tb\tc\nx\t1\t2\ny\t3\t4"), ("table", "| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |"), ("table", "town       people   since\nAltdorf    5120     1806\nBergen     901      1910"), ("table", "{|\n! a !! b !! c\n|-\n| x || 1 || 2\n|}"), ("table", "<table><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"),
        ("junk", "xkqzv wrtplk bbvcn zzkqpw mnrtvb qqwrtz kjhgfd lkmnbv"), ("junk", "Home | Login | About us | Top | Search"), ("junk", "@#$ %%^ &*! ??? ;;; :::"), ("junk", "Loading... Retry? Loading... Retry? Loading... Retry? Loading... Retry? Loading... Retry? Loading... Retry?"),
        ("junk", "2025-01-01 10:00:00 INFO worker=3 rc=0\n2025-01-01 10:00:05 WARN worker=4 rc=1"), (None, " "), (None, None),
    ],
)
def test_kinds(kind, text):
    assert shape.kind_of(text) == kind


def test_mixture_finds_the_kinds(spark):
    texts = [PROSE + f" Number {i} came late, but it was there." for i in range(40)]
    texts += ["\n".join(f"- entry {i} of {j}" for j in range(8)) for i in range(12)] + ["\n".join(f"r{j}\t{i}\t{j * 7}" for j in range(8)) for i in range(12)] + [" ".join(f"{i * 7919 + j * 104729:08x}" for j in range(20)) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kind for r in shape.shapes(df).collect()}
    want = ["prose"] * 40 + ["list"] * 12 + ["table"] * 12 + ["junk"] * 12
    assert [got[i] for i in range(len(texts))] == want


def test_the_mixture_decides(spark, monkeypatch):
    texts = [PROSE + f" Number {i} came late, but it was there." for i in range(30)] + ["\n".join(f"- entry {i} of {j}" for j in range(8)) for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fit = shape.fit_mixture

    def swapped(stats):
        m = fit(stats)
        m.kinds = [{"prose": "table", "list": "junk"}.get(k, k) for k in m.kinds]
        return m

    monkeypatch.setattr(shape, "fit_mixture", swapped)
    got = {r.doc_id: r.kind for r in shape.shapes(df).collect()}
    assert [got[i] for i in range(len(texts))] == ["table"] * 30 + ["junk"] * 10


def test_shares_break_ties_alone():
    half = np.full((2, len(shape.USED)), 0.0)
    m = shape.Mixture(np.zeros(len(shape.USED)), np.ones(len(shape.USED)), np.array([0.5, 0.5]), half, half + 1, ["prose", "junk"])
    row = dict.fromkeys(shape.STATS, 0.0) | {"words": 9.0, "list_share": 0.6, "prose_share": 0.4}
    assert shape.decide(m, np.array([list(row.values())])) == ["list"]
    m.weights = np.array([0.95, 0.05])
    assert shape.decide(m, np.array([list(row.values())])) == ["prose"]
    m.pure = np.array([False, True])  # a component of several shapes stands for no kind
    assert shape.decide(m, np.array([list(row.values())])) == ["list"]


def test_em_sums_do_not_depend_on_partitions(spark):
    texts = [PROSE[: 40 + 3 * i] for i in range(30)] + ["- a\n- b\n- c\n- d"] * 5
    stats = shape.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    a, b = shape.fit_mixture(stats.repartition(1)), shape.fit_mixture(stats.repartition(5))
    assert np.allclose(a.means, b.means, atol=1e-6) and a.kinds == b.kinds


@pytest.fixture(scope="module")
def model():
    lines = {
        "en": "The library counted the missing reports because the editors had lost them. Nobody knew when they would be back.",
        "de": "Die Bücherei zählt die fehlenden Berichte, weil die Redaktion sie verloren hat. Niemand wusste, wann sie zurück sind.",
        "nl": "De bibliotheek telt de ontbrekende verslagen, omdat de redactie ze heeft verloren. Niemand wist wanneer ze terug zijn.",
        "fr": "La bibliothèque compte les dépêches perdues parce que la rédaction les a oubliées. Personne ne savait quand elles reviendraient.",
        "es": "La biblioteca cuenta los informes perdidos porque la redacción los ha olvidado. Nadie sabía cuándo volverían.",
        "it": "La biblioteca conta le relazioni perdute perché la redazione le ha dimenticate. Nessuno sapeva quando sarebbero tornate.",
        "pt": "A biblioteca conta os relatórios perdidos porque a redação os esqueceu. Ninguém sabia quando voltariam.",
        "ru": "Библиотека считает потерянные отчёты, потому что редакция их забыла. Никто не знал, когда они вернутся.",
    }
    return language.train([(k, v) for k, v in lines.items() for _ in range(3)])


HELD_OUT = {
    "en": "The weather was cold, but the children had fun with the snow in front of the house.", "de": "Das Wetter war kalt, aber die Kinder hatten vor dem Haus viel Freude mit dem Schnee.",
    "nl": "Het weer was koud, maar de kinderen hadden voor het huis veel plezier met de sneeuw.", "fr": "Le temps était froid, mais les enfants jouaient avec la neige devant la maison.",
    "es": "El tiempo era frío, pero los niños jugaban con la nieve delante de la casa.", "it": "Il tempo era freddo, ma i bambini giocavano con la neve davanti alla casa.",
    "pt": "O tempo estava frio, mas as crianças não paravam de brincar com a neve diante da casa.", "ru": "Погода была холодной, но дети играли со снегом перед домом.",
}


@pytest.mark.parametrize("lang", sorted(HELD_OUT))
def test_held_out_sentences(model, lang):
    assert list(language.judge(model, [HELD_OUT[lang]]).shares(0)) == [lang]


def test_mixed_documents(spark, model):
    df = spark.createDataFrame([(1, HELD_OUT["en"] + "\n\n" + HELD_OUT["ru"], "de"), (2, HELD_OUT["de"], "de-AT"), (3, HELD_OUT["de"], "xx"), (4, "a\tb\tc\nd\t1\t2", None)], "doc_id long, text string, lang string")
    rows = language.document_languages(df, model, label_col="lang").collect()
    cases = {(r.doc_id, r.lang) for r in rows if r.kind in ("prose", "list")}
    assert cases == {(1, "en"), (1, "ru"), (3, "de")} and all(0 < r.confidence <= 1 for r in rows)
    assert [(r.segment, r.lang) for r in language.segments(df.filter("doc_id = 1"), model).orderBy("segment").collect()] == [(0, "en"), (1, "ru")]


@pytest.mark.parametrize(("label", "code"), [("en-US", "en"), ("German", "de"), ("POR", "pt"), (" русский ", "ru"), ("xx", None), ("bg", None), ("", None), (None, None)])
def test_labels(spark, label, code):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(label,)], "x string").select(language.language_of_label(F.col("x"))).first()[0] == code


@pytest.mark.parametrize(("word", "n"), [("the", 1), ("cat", 1), ("walked", 1), ("wanted", 2), ("table", 2), ("houses", 2), ("idea", 2), ("nation", 2), ("methodology", 5), ("machine", 2), ("queue", 1), ("x", 1)])
def test_syllables(word, n):
    assert reading.syllables(word) == n


def test_bands():
    easy = "The cat sat on the mat. The dog ran to the cat. It was a good day. Look at the sun!"
    hard = "Insofar as methodological heterogeneity necessarily presupposes interdisciplinary collaboration, subsequent operationalisation of theoretically significant characteristics systematically complicates the interpretation of longitudinal investigations. Notwithstanding terminological ambiguity, comparatively conservative generalisation retrospectively legitimises institutional documentation."
    assert reading.band_of(reading.reading_level(easy)[0]) == "basic" and reading.band_of(reading.reading_level(hard)[0]) == "advanced"
    assert reading.band_of(reading.reading_level(PROSE + " The committee reported the result later.")[0]) == "middle"
    assert reading.reading_level(None) is None and reading.reading_level("...") is None


def test_cut_points_leave_fewest_on_the_wrong_side():
    rng = np.random.default_rng(3)
    graded = [("basic", g) for g in rng.normal(0, 0.8, 300)] + [("middle", g) for g in rng.normal(9, 1.5, 500)] + [("advanced", g) for g in rng.normal(28, 3, 300)]
    graded += [("middle", 0.1), ("middle", 30.0), ("basic", 28.0), ("advanced", 8.0)]  # wrong labels
    low, high = reading.cut_points(graded)
    assert 2 < low < 5.5 and 13 < high < 22
    held = [("basic", g) for g in rng.normal(0, 0.8, 300)] + [("middle", g) for g in rng.normal(9, 1.5, 500)] + [("advanced", g) for g in rng.normal(28, 3, 300)]
    assert sum(reading.band_of(g, (low, high)) == b for b, g in held) >= 0.98 * len(held)
    assert reading.cut_points([]) == reading.cut_points([("middle", 5.0)]) == (reading.BASIC, reading.ADVANCED)
    for below, above in (([1.0, 2.0], [4.0]), ([3.0], [3.0]), ([5.0, 1.0], [3.0, 9.0])):  # against every cut
        cut = reading.cut_point(below, above)
        if cut is not None:
            wrong = lambda c, b=below, a=above: sum(g > c for g in b) + sum(g <= c for g in a)
            assert wrong(cut) == min(wrong(c) for c in [*below, *above])


def test_bands_are_fitted_on_labelled_texts(spark, monkeypatch):
    easy, plain = "The cat sat. The dog ran. It was fun.", PROSE
    hard = "Notwithstanding considerable methodological heterogeneity, longitudinal investigations unequivocally demonstrate extraordinary interindividual variability throughout institutional configurations."
    texts = [t for t in (easy, plain, hard) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    bands = ["basic"] * 12 + ["middle"] * 12 + ["Advanced "] * 12
    labels = spark.createDataFrame([*enumerate(bands), (36, "basic"), (99, "middle"), (None, "basic"), (3, None), (5, "middle")], "doc_id long, reading_band string")
    low, high = reading.fit_bands(df, labels)
    grade = [reading.reading_level(t)[0] for t in (easy, plain, hard)]
    assert grade[0] < low < grade[1] < high < grade[2]
    assert (low, high) == ((grade[0] + grade[1]) / 2, (grade[1] + grade[2]) / 2)
    monkeypatch.setattr(reading, "BAND_TEXTS", 4)
    assert reading.fit_bands(df, labels) == (low, high)
    assert reading.fit_bands(df.limit(0), labels) == reading.fit_bands(df, labels.limit(0)) == (reading.BASIC, reading.ADVANCED)
