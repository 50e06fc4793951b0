"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest

from textquarry.llm import encoding, language, leaks, queries, shape, truncation


def test_shapes_follow_the_mixture(spark, monkeypatch):
    class AllLists(shape.Mixture):
        def __init__(self):
            self.kinds, self.pure = ["list"], np.array([True])

        def responsibilities(self, x):
            return np.ones((len(x), 1)), np.zeros(len(x))

    text = "The old mill was closed for the winter and nobody in the village knew why.\n- milk\n- bread\n- two apples\n- some green tea\n- five eggs\n- honey\n- flour\n- sugar\n- salt"
    s = dict(zip(shape.STATS, shape.statistics(text), strict=True))
    assert 0.5 <= s["prose_share"] < 0.55 and s["list_share"] >= 0.45
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatch.setattr(shape, "fit_mixture", lambda stats: AllLists())
    assert [r.kind for r in shape.shapes(df).collect()] == ["list"] and shape.kind_of(text) == "prose"


def test_file_records_are_repaired_in_their_columns(spark, tmp_path):
    rows = [(1, {"a": "Ã©tÃ©", "b": "sound", "c": "GrÃ¶ÃŸe"}), (2, None), (3, {"a": None, "b": "été"})]
    spark.createDataFrame(rows, "record_id long, content map<string,string>").write.parquet(f"{tmp_path}/file_records.parquet")
    spark.createDataFrame([(7, "Ã©tÃ©"), (8, "été")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.tab, r.rec_id, r.column, r.repaired) for r in queries.QUERIES["p1_repaired"](spark, str(tmp_path)).collect()}
    assert got == {("documents", 7, "text", "été"), ("file_records", 1, "a", "été"), ("file_records", 1, "c", "Größe")}


@pytest.mark.parametrize("n", range(4))
def test_copies_take_no_places_in_the_training_sample(spark, monkeypatch, n):
    monkeypatch.setattr(language, "TRAIN_DOCUMENTS", 20)
    monkeypatch.setattr(language, "train", lambda examples, seed: examples)
    rows = [(f"Deze tekst nummer {n} staat in een derde van alle rijen van de tabel.", "nl")] * 1000
    rows += [(f"Dit is een andere tekst, met het nummer {i}, en die komt maar een keer voor.", "nl") for i in range(60)]
    rows += [(f"This is another text, with the number {i}, and it is found only once.", "en") for i in range(2000 + n)]
    rows += [(f"Dies ist ein anderer Text mit der Nummer {i}, den es nur einmal gibt.", "de") for i in range(5)]
    got = language.fit_model(spark.createDataFrame(rows, "t string, l string").repartition(4), "t", "l")
    assert len(set(got)) == len(got) and [sum(c == x for c, _ in got) for x in ("nl", "en", "de")] == [20, 20, 5]


def test_long_block_at_the_end_is_no_last_sentence(spark):
    text = "We walked along the river for an hour before it began to rain. Nobody had brought a coat, so we waited under the bridge.\n"
    inner = "because the old mill was closed for the winter and " * 200
    blocks = [f"<!-- {inner}-->", f"<!-- {inner[:500]}-->", "then we went home because the"]
    assert len(inner) > 10_000
    df = spark.createDataFrame([(i, text + b, "s") for i, b in enumerate(blocks)], "doc_id long, text string, source string")
    assert [r.doc_id for r in truncation.unfinished(df).collect()] == [2]


def test_ends_of_any_length_are_judged_whole(spark):
    start = "The index sorted the weekly reports after the second review. The archive kept the raw pages with great care. "
    rows = [start] * 6
    long = "The clerk saw " + ", ".join(f"paper {i} of box {i * i} on shelf {i + 7}" for i in range(80))
    assert len(long) > 2000
    rows += [start + long + ", and the archive kept the", start + long + ", and the archive kept the raw pages with great care"]  # the first is cut, in a sentence of over 2,000 characters
    signs = " --*" * 3000  # 12,000 characters without a word behind the last one
    rows += [start + "The archive kept the" + signs, start + "The archive kept the raw pages." + signs]
    table = "".join(f"\n| {i} | {i * 3} | {i * 7} |" for i in range(900))  # the words of the text are those of its table
    assert len(table) > 10_000
    rows += [start + table, start + "The archive kept the" + table]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in truncation.truncated(df).collect()) == [6, 8]


def test_truncation_is_sql_throughout(spark):
    df = spark.createDataFrame([(1, "The archive kept the", "s"), (2, "The archive kept the old letters.", "s")], "doc_id long, text string, source string")
    plans = []
    run = truncation._run

    def seen(*args, **tables):
        plans.append(run(*args, **tables))
        return plans[-1]

    truncation._run = seen
    try:
        truncation.unfinished(df).collect()
    finally:
        truncation._run = run
    assert len(plans) >= 6 and not any(x in p._jdf.queryExecution().executedPlan().toString() for p in plans for x in ("Python", "MapIn", "Pandas", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize(
    ("prose", "text"),
    [
        (True, "We walked along the river for an hour before it began"), (True, "the old mill was closed for the winter and nobody knew why\nwe asked the owner about it after the meeting was over"), (True, "Take these:\n- milk\n- bread\nWe walked along the river for an hour before it began to rain. Nobody had brought a coat, so we"),
        (False, "- milk\n- bread\n- two apples\n- some tea"), (False, "the milk\nthe bread\ntwo apples\nsome tea\nfive eggs"), (False, "<ul><li>the milk</li><li>bread</li><li>some tea</li></ul>"), (False, "the milk; two apples; some tea; the bread\nfive eggs; a jar of honey; the flour"),
        (False, "a\tb\tc\nx\t1\t2\ny\t3\t4"), (False, "| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |"), (False, "{|\n! a !! b !! c\n|-\n| x || 1 || 2\n|}"), (False, "<table><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"),
        (False, "xkqzv wrtplk bbvcn zzkqpw mnrtvb qqwrtz kjhgfd lkmnbv"), (False, "Home | Login | About us | Top | Search"), (False, "cat tree cat tree tree house cat tree house house cat tree cat tree house cat"), (False, "2025-01-01 10:00:00 INFO worker=3 rc=0\n2025-01-01 10:00:05 WARN worker=4 rc=1"), (False, "4377 5163497 37 6046345 9495807"),
    ],
)
def test_prose_in_sql(spark, prose, text):
    df = spark.createDataFrame([(1, "s", len(text), len(text), text)], "doc_id long, source string, chars int, bytes int, text string")
    assert truncation._run(spark, truncation.PROSE.replace("{plain}", truncation._plain("text")), ends=df).count() == prose


@pytest.mark.parametrize(("before", "after"), [("Für größere Übungen prüfen Ärzte böse Füchse. " * 5, ""), ("", " Für größere Übungen prüfen Ärzte böse Füchse." * 5), ("À la fin, voilà là où ça va très bien, à côté. ", " Là, déjà à l’été.")])
def test_offsets_of_leaks_in_unevenly_damaged_text(before, after):
    passage = "which river flows through the largest city of the northern province near the old harbour"
    damaged = [encoding.read_bytes(x.encode(), "cp1252").replace("\xa0", " ") for x in (before, passage, after)]
    items = leaks.Items([(1, passage + "?"), (2, "how many stones were used for the tall bridge")])
    items.prepare()
    (_, _, start, end), *_ = leaks.leaks(items, "".join(damaged))
    assert "".join(damaged)[start:end] == passage


def test_offsets_at_both_ends_of_a_replaced_span():
    damaged = "vor GrÃ¶ÃŸe nach"
    (_, fixed, *_), passes = encoding.repair_spans(damaged)
    s = fixed.index("Größe")
    assert fixed == "vor Größe nach" and damaged[encoding.offset_before(passes, s) : encoding.offset_before(passes, s + 5, end=True)] == "GrÃ¶ÃŸe"
    assert damaged[encoding.offset_before(passes, fixed.index("nach")) :] == "nach"


def test_items_beyond_the_bound_are_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "which river flows through the largest city of the northern province")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "which river flows through the largest city of the northern province?"), (8, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, items).collect()] == [(1, 7)]
    assert leaks.leaked_items(docs, items.limit(0)).count() == 0
    monkeypatch.setattr(leaks, "MOST_ITEM_CHARS", 10)
    with pytest.raises(ValueError, match="in parts"):
        leaks.leaked_items(docs, items)


@pytest.mark.parametrize("cut", [0, 3, 6])
def test_leaks_that_open_a_text_inside_the_item(cut):
    item = "which river flows through the largest city of the northern province near the old harbour of Velri"
    items = leaks.Items([(1, item + "?"), (2, "how many stones were used for the tall bridge")])
    items.prepare()
    passage = " ".join(item.split()[cut:])
    (_, share, start, end), *_ = leaks.leaks(items, passage + ". Then came other words of the text.")
    assert (start, end) == (0, len(passage)) and share == (17 - cut) / 17
