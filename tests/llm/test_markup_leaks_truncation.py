import pytest

from textquarry.llm import leaks, markup, truncation


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("<p>Hello</p>", ["html"]), ("a<br>b", ["html"]), ("x &nbsp; y", ["html"]), ("&lt;p&gt;x&lt;/p&gt;", ["html"]), ("x <!-- c --> y", ["html"]), ("caf&#233;", ["html"]),
        ("# Title\ntext", ["markdown"]), ("a **bold** word", ["markdown"]), ("see [this](http://a.b/c)", ["markdown"]), ("```\ncode\n```", ["markdown"]), ("Title\n=====\ntext", ["markdown"]), ("> said so", ["markdown"]), ("a ~~gone~~ b", ["markdown"]), ("call `f()` now", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
        ("a [[link|text]] b", ["wiki"]), ("== Title ==\ntext", ["wiki"]), ("'''bold''' text", ["wiki"]), ("{{cite|x}}", ["wiki"]), ("{|\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"]), ("[https://a.b c d]", ["wiki"]),
        ("\\section{T} text", ["latex"]), ("so $x^2 + y_1$ holds", ["latex"]), ("Some more text was cited here.~\\cite{a2000}", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]), ("\\(a \\log b\\)", ["latex"]),
        ("$\\alpha$\n\n# Title", ["markdown", "latex"]),
        ("I <3 tidy data, and a < b and b > c.", []), ("Prices ran from $5 to $12.", []), ("R&D in C:\\corpus\\raw", []), ("See [3] and [12].", []), ("a Map<String, Integer> held", []), ("The field doc_id_new replaced old_doc_id.", []), ("It took 3 * 4 * 2 hours.", []), ("Posts tagged #cleanup and #corpus", []), ("size==0 {draft} 100% & more", []), ("- one\n- two\n* three", []), ("a\tb\n1\t2", []), ("", []), (None, []),
    ],
)
def test_kinds(text, kinds):
    assert markup.convert(text)[0] == kinds


def test_structure_survives():
    page = "<nav><a href=/>Home</a> <a href=/x>More links here</a></nav><div><h2>Head</h2><p>First <b>long</b> paragraph with many words in it, to be kept.</p><ul><li>one</li><li>two</li></ul><pre>a  b\nc</pre><table><tr><td>x</td><td>1</td></tr></table><p>Last words &amp; more of them, long enough to count as content.</p></div><script>no()</script>"
    clean = markup.convert(page)[1]
    assert "Home" not in clean and "no()" not in clean
    assert "## Head" in clean and "- one\n- two" in clean and "```\na  b\nc\n```" in clean and "x | 1" in clean and "words & more" in clean
    assert markup.convert("\\subsection{T}\n\\begin{equation}\nx^2\n\\end{equation}\n\\textbf{b} text~\\cite{k}")[1] == "## T\n\n$$x^2$$\nb text"
    assert markup.convert("So \\emph{\\hat{x} \\le y} and \\textbf{bold} words.")[1] == "So $\\hat{x} \\le y$ and bold words."
    assert markup.convert("== T ==\n'''b''' [[a|c]] {{x}}\n{|\n! h !! i\n|-\n| 1 || 2\n|}")[1] == "# T\nb c\nh | i\n1 | 2"
    assert markup.convert("T\n===\n**b** [l](http://x)\n* e")[1] == "# T\nb l\n- e"


PROSE = "The old ferry left the harbour before noon, and nobody on the quay could say when it would be back again. "
PAGE = (
    "<div><div class=side>Three new pages</div>"
    "<div><h1>The ferry</h1><p>" + PROSE * 4 + "</p><p>" + PROSE * 5 + "</p><ul><li>one rope</li><li>two oars</li></ul><p>" + PROSE * 3 + "</p></div>"
    "<ul><li><a href=/a>Start of all pages</a></li><li><a href=/b>Other pages here</a></li></ul><pre>x = 1\ny = 2</pre><div>All rights kept</div></div>"
)


def test_density_decides_what_is_content(monkeypatch):
    clean = markup.convert(PAGE)[1]
    assert clean.startswith("# The ferry") and clean.count("old ferry") == 12 and "- one rope\n- two oars" in clean and "```\nx = 1\ny = 2\n```" in clean
    assert not any(x in clean for x in ("Three new pages", "Start of all", "Other pages", "All rights"))

    def whole(root):
        root.content = True
        return root, 0.0

    monkeypatch.setattr(markup, "mark_content", whole)  # with the root instead of the chosen subtree all of it stays
    assert all(x in markup.convert(PAGE)[1] for x in ("Three new pages", "Start of all", "All rights"))


def test_texts_with_words_outside_tags_are_kept_whole():
    text = "A short word first.\n<ul><li>" + "</li><li>".join(["a rather long entry of a list"] * 9) + "</li></ul>\nAnd <b>one</b> last."
    clean = markup.convert(text)[1]
    assert clean.startswith("A short word first.") and clean.endswith("And one last.") and clean.count("- a rather") == 9


def test_long_tags_and_formulas_have_no_limit():
    tag = "".join(f" data-k{i}='{i * i}'" for i in range(200))
    assert markup.convert(f"&lt;p{tag}&gt;Some words here.&lt;/p&gt;") == (["html"], "Some words here.")
    sums = " + ".join(f"a_{{{i}}}" for i in range(200))
    assert markup.convert(f"{PROSE}So ${sums}$ holds.")[0] == ["latex"] and markup.convert(f"{PROSE}So \\({sums}\\) holds.")[0] == ["latex"]
    words = " ".join(f"word{i}" for i in range(200))
    assert markup.convert(f"{PROSE * 9}An *{words}* ends.")[0] == ["markdown"]


def test_deep_nesting_ends():
    assert "x" in markup.convert("<div>" * 3000 + "x" + "</div>" * 3000)[1]
    clean = markup.convert("<div>" * 1000 + "<h2>Deep</h2><ul><li>one</li><li>two</li></ul>" + "</i></div>" * 1000)[1]
    assert clean == "## Deep\n\n- one\n- two"


ITEMS = leaks.Items(
    [(k, f"Read the text and choose. {t}") for k, t in ((1, "Two crates of copper bells weigh as much as nine hundred salt jars carved by one potter in Garlor."), (2, "A florist packs 224 cork floats into 557 lockers and hands 576 to the neighbour of Denost before noon."), (3, "A florist packs 118 pear tarts into 902 lockers and hands 33 to the neighbour of Velri before noon."))]
    + [(9, None)]
)
ITEMS.prepare()


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Before. Two crates of copper bells weigh as much as nine hundred salt jars carved by one potter in Garlor. After.", {1}),
        ("TWO CRATES of **copper** bells weigh, as much\nas nine hundred tin jars carved by one potter", {1}),
        ("A florist packs 224 cork floats into 557 lockers and hands 576 to the neighbour of Denost before noon", {2}),
        ("A florist packs 999 glass beads into 111 lockers and hands 12 to the neighbour of Koden before noon", set()),
        ("Read the text and choose. Something else.", set()), ("copper bells weigh as much", set()), ("", set()), (None, set()),
    ],
)
def test_leaks(text, found):
    assert {i for i, *_ in leaks.leaks(ITEMS, text)} == found


def test_offsets_lead_back():
    text = "Intro – here. Two crates of copper bells weigh as much as nine hundred salt jars carved by one potter in Garlor. End."
    (_, share, start, end), *_ = leaks.leaks(ITEMS, text)
    assert text[start:end].startswith("Two crates") and text[start:end].endswith("Garlor") and share > 0.7


def test_alignment_is_longest():
    a, b = "a b c d e f".split(), "x a c b d q f".split()
    pairs = leaks.align(a, b)
    assert len(pairs) == 4 and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def corpus(spark, *ends):
    whole = ["The index sorted the weekly reports after the second review. The archive kept the raw pages with great care.", "Our group checked the weekly reports after the second review. The library kept the old letters with great care."]
    rows = [(i, whole[i % 2], "open") for i in range(40)] + [(100 + i, e, "open") for i, e in enumerate(ends)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_cut_texts(spark):
    start = "The index sorted the weekly reports after the second review. "
    ends = [
        start + "The archive kept the", start + "The archive kept the raw pa", start + "The library kept the old letters with great…",  # cut
        start + "The archive kept the raw pages with great care", start + "The archive kept the raw pages with great care.\nBest wishes\nAnna", start + "To be continued...", "", None,  # not cut
    ]
    got = {r.doc_id for r in truncation.truncated(corpus(spark, *ends)).collect()}
    assert got == {100, 101, 102}
    rates = {r.source: (r.texts, r.truncated) for r in truncation.rates(corpus(spark, *ends)).collect()}
    assert rates["open"] == (46, 3)


def test_field_limit(spark):
    words = ["river", "stone", "cloud", "paper", "candle", "window", "garden", "lantern"]
    rows = [(i, (" ".join(words[(i + k) % 8] + f"{(i * 7 + k) % 13}" for k in range(60)) + " of the day")[:120], "field") for i in range(12)]
    rows += [(50, "All of it fits. " * 7 + "It ends.", "field")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    at = {r.doc_id for r in truncation._run(spark, truncation.LIMITS.replace("{texts}", "5").replace("{share}", "0.04"), docs=df).filter("by_chars").select("chars_limit").withColumnRenamed("chars_limit", "doc_id").collect()}
    assert at == {120}
