"""Per-document text statistics and, from them, prose, list, table or junk.

Method: a Gaussian mixture is fitted by expectation-maximization on the standardized statistics of all documents
(each iteration is one distributed pass that sums sufficient statistics), and its components are mapped to the
four kinds by inspected examples. A document is of the kind that its components make most probable; only where that
probability stays below SURE, or where the component holds documents of several shapes (PURE), its own word shares break
the tie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.encoding import repair
from textquarry.runtime import map_texts, materialize

#: Frequent function words of the eight languages.
COMMON = {
    "en": "the a an and of in to was were is are it its that this with for at on by from because although while when had has have but so or not then if as under over after before into our my some most all each every i we you",
    "de": "der die das den dem des ein eine einen einem einer und in im mit nach von zu für auf am an über ist war nicht weil dass obwohl warum seit bei auch es wegen jede jeder aus als sich wenn",
    "fr": "le la les l un une des du de d et en à au aux que qui est sont dans pour par pas ne sur avec ce cette même si mais parce il elle depuis dès plus sans sa son ses chaque pendant",
    "es": "el la los las un una de del y en a al que es por con para no su se pero porque aunque lo más sin sobre desde cada también qué durante según",
    "it": "il lo la gli le l un una di del della dello dei delle e in a al alla che è per con non si ma perché anche nel nella dopo ogni più da gli senza sul",
    "pt": "o a os as um uma de do da dos das e em no na que é por com para não se mas porque ao num numa mais desde cada embora sem sobre até durante",
    "nl": "de het een en van in op te dat is was voor met niet aan om bij omdat maar ook elke elk na over er uit als zijn door waarom geen hoewel sinds gedurende",
    "ru": "и в на не с что по к из за для но а о от у же это как потому почему при очень без весь всю каждую после до он она они",
}
STOPS = frozenset(w for ws in COMMON.values() for w in ws.split())
#: Words of page furniture.
FURNITURE = frozenset("home menu login logout share top next previous newer older back about us contact archive feed search sign register help privacy terms cookies page subscribe tags rss sitemap faq print tweet skip navigation".split())

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W\d_]+)*")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&(?:lt|gt|amp|nbsp|quot|#\d+|#x[0-9a-fA-F]+|[a-z]{2,8});|<!--.*?-->", re.S)
_ESCAPED = re.compile(r"&(?:amp;)?lt;\s*(/?[A-Za-z!](?:[^<>&]|&(?!(?:amp;)?[lg]t;))*)&(?:amp;)?gt;")
_BREAK = re.compile(r"(?i)</?(?:li|tr|p|div|ul|ol|table|h[1-6]|br|hr|dt|dd|section|article|blockquote)\b[^<>]*>")
_CELL = re.compile(r"(?i)</(?:td|th)\s*>\s*(?:<(?:td|th)\b[^<>]*>)?")
_LI = re.compile(r"(?i)<(?:li|dt|dd)\b[^<>]*>")
_SETUP = re.compile(r"^\s*(?:\{\||\|\}|\|-|\|?[\s:|-]+\|?$|\\(?:begin|end)\{[^}]*\}.*$|\\hline|\\(?:top|mid|bottom)rule|```\w*$)")
_MARK = re.compile(r"^\s*(?:[-*+•·–—▪◦‣o]\s+|\*+\s*|#+\s*(?=\[\[)|\(?\d{1,3}[.)\]:]\s+|\(\d{1,3}\)\s*|\(?[A-Za-zа-я][.)]\s+|\[\d{1,3}\]\s+|\\item\b\s*(?:\[[^\]]*\])?|[ivxIVX]{1,5}[.)]\s+|[A-Z]\d?[.:]\s+|\[[ xX]\]\s+)")
_END = re.compile(r"[.!?…。]['\"”’»)\]*_~]*\s*(?:\\\\|\[\d+\]|~?\\cite\{[^}]*\})?\s*$")
_SPACES = re.compile(r"(?<=\S)(?:\t| {2,})\s*(?=\S)")
_NUM = re.compile(r"^[-+]?[\d.,:%$€/]+$")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={2,}.*={2,}\s*$|\\(?:sub)*section)")
_LOG = re.compile(r"\b\w+=[\w./:-]+|\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\b(?:INFO|WARN|ERROR|DEBUG)\b")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœаеёиоуыэюя]", re.I)
_HARD = re.compile(r"[^aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœýаеёиоуыэюя\W\d_'’-]{6,}", re.I)

STATS = ("words", "list_share", "table_share", "prose_share", "odd_share", "common_share", "mean_word", "symbols", "numbers", "ended", "line_words", "variety")


def _cells(line: str) -> list[str]:
    """The cells of a row; one where the line is no row."""
    s = line.strip()
    if "||" in s or "!!" in s:
        return [c.strip() for c in re.split(r"\|\||!!", s.lstrip("|!"))]
    if s.startswith("|") or s.count("|") >= 2:
        return [c.strip() for c in s.strip("|").split("|")]
    if s.count(" & ") >= 1 and (s.endswith("\\\\") or "\\hline" in s):
        return [c.strip() for c in s.rstrip("\\").split("&")]
    if "\t" in s or _SPACES.search(s):
        return [c for c in re.split(r"\t+| {2,}", s) if c]
    for d in (";", ","):
        if s.count(d) >= 2 and " " + d not in s:
            parts = s.split(d)
            if not any(p.startswith(" ") for p in parts[1:]) and max(len(p.split()) for p in parts) <= 8:
                return parts
    return [s]


def plain_lines(text: str) -> list[tuple[str, bool]]:
    """(line without tags, it came from a list entry); cells of HTML rows are set apart by tabs."""
    if "&lt;" in text:
        text = _ESCAPED.sub(r"<\1>", text)
    if "<" in text or "&" in text:
        text = re.sub(r"<!--.*?-->", " ", text, flags=re.S)
        if "<t" in text.lower():
            text = _CELL.sub("\t", re.sub(r"(?i)(</t[dh]>)\s*\n\s*(?=<t[dh])", r"\1", text))
        text = _TAG.sub(" ", _BREAK.sub("\n", _LI.sub("\n\x01 ", text)))
    return [(ln.lstrip(" ").removeprefix("\x01"), ln.lstrip(" ").startswith("\x01")) for ln in re.split(r"[\r\n]+", text)]


def _nonsense(ws: list[str]) -> bool:
    """Mostly words that no language has: overlong, letters between digits, or hardly a vowel."""
    odd = 0
    for w in ws:
        if len(w) > 4 and (len(w) > 22 or (not w.isalpha() and not w.isdigit() and w.isalnum()) or _HARD.search(w)):
            odd += 1
    return odd > 0.3 * len(ws)


def statistics(text: str | None) -> tuple[float, ...] | None:
    """The numbers of STATS; None for null or blank text.

    Shares are of words: in entries of an enumeration, in rows of cells, in running sentences, in what no reader could use.
    """
    if text is None or not text.strip():
        return None
    if not text.isascii():
        text = repair(text)[1]
    n = n_list = n_table = n_prose = n_odd = lines = ended = common = letters = numbers = furniture = singles = 0
    types: set[str] = set()
    run: list[int] = []  # words of unmarked short lines that follow one another

    def flush() -> None:
        nonlocal n_list, n_prose
        if len(run) >= 4:
            n_list += sum(run)
        else:
            n_prose += sum(run)
        run.clear()

    columns = 0
    for line, entry in plain_lines(text):
        if not line.strip() or (_SETUP.match(line) and not entry):
            continue
        ws = _WORD.findall(line)
        k = len(ws)
        bare = 0
        if k < 4 or line.count(" ") > 1.6 * k:
            bare = sum(1 for x in line.split() if x.strip("=#*|-_~>+.:•–·{}[]"))
            if k < 0.5 * bare:
                k = bare
        if not k:
            continue
        low = line.lower()
        low = [w.lower() for w in ws] if len(low) != len(line) else _WORD.findall(low)
        c = sum(map(STOPS.__contains__, low))
        n += k
        lines += 1
        common += c
        letters += sum(map(len, ws))
        types.update(low)
        end = bool(_END.search(line[-40:]))
        ended += end
        digits = sum(w[0].isdigit() for w in ws)
        numbers += digits
        f = 0 if k > 24 else sum(map(FURNITURE.__contains__, low))
        furniture += f
        if k >= 12 and end and c >= 0.12 * k and "|" not in line and "\t" not in line:  # running text, the usual case
            if run:
                flush()
            n_prose += k
            continue
        cells = _cells(line)
        if end and len(cells) > 1 and "|" not in line and "\t" not in line and not line.rstrip().endswith("\\\\"):
            cells = [line]
        mark = _MARK.match(line)
        if "=" in line and len(_LOG.findall(line)) >= 2:
            n_odd += k
            flush()
        elif f >= 0.25 * k and not end or (digits == len(ws) and len(cells) == 1):
            n_odd += k
            flush()
        elif len(cells) >= 3 or (len(cells) == 2 and (columns >= 2 or "\t" in line or line.lstrip().startswith("|")) and not end and max(len(x.split()) for x in cells) <= 8):
            columns = len(cells)
            n_table += k
            flush()
        elif len(ws) < 0.5 * bare or (c < 0.25 * k and _nonsense(ws)) or f > 0.5 * k:
            n_odd += k
            flush()
        elif (entry or (mark and mark.group().strip())) and k <= 16 and not (end and k > 9):
            n_list += k
            flush()
        elif not end and line.count("; ") >= 2 and (pieces := line.split(";")) and max(len(x.split()) for x in pieces) <= 8:
            n_list += k
            flush()
        elif _HEADING.match(line):
            n_prose += k
        elif k <= 7 and not end:
            run.append(k)
            singles += k == 1 and len(line.strip()) == 1
        else:
            if run:
                flush()
            if k >= 12 and c < 0.06 * k and not end:
                n_odd += k
            else:
                n_prose += k
        if len(cells) < 2:
            columns = 0
    flush()
    if not n:
        size = len(text.split())
        return (float(size), 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, float(np.log1p(size)), 1.0)
    if (n >= 12 and len(types) <= 8 and len(types) < 0.4 * n) or furniture > 0.3 * n or (singles >= 5 and singles > 0.4 * lines):
        # a few words over and over, a page's furniture between names, or letters one below the other
        n_list = n_table = n_prose = 0
        n_odd = n
    solid = sum(map(len, text.split()))
    return (
        float(n), n_list / n, n_table / n, n_prose / n, n_odd / n, common / n, letters / n, min(1.0, max(0.0, 1 - letters / max(solid, 1))),
        numbers / n, ended / lines, float(np.log1p(n / lines)), len(types) / n,
    )


# ---- the mixture -------------------------------------------------------------------------------------

#: Statistics that the mixture sees; the number of words alone says nothing about shape.
USED = STATS[1:]
KINDS = ("prose", "list", "table", "junk")
#: Smallest variance of a component, in standardized units: shares are often exactly 0 or 1.
LEAST_VARIANCE = 0.02
#: Probability of a kind below which the mixture is unsure and the document's own word shares break the tie.
SURE = 0.9
#: Share of words that some kind must have in the mean of a component; a component below that holds documents of several
#: shapes, stands for no kind, and leaves its documents to their own shares.
PURE = 0.7

#: Inspected examples, two or three groups for each kind; a group starts one component and names its kind.
EXAMPLES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("prose", (
        "We walked along the river for an hour before it began to rain. Nobody had brought a coat, so we waited under the bridge until the worst was over.",
        "Der Zug hatte wieder Verspätung, und niemand wusste warum. Am Ende nahmen wir den Bus und kamen doch noch an.",
        "Le marché ouvre à huit heures, mais les premiers clients arrivent avant. On y trouve des fruits, du pain et des fleurs pour la maison.",
        "La biblioteca abre por la mañana y cierra a las seis. Los libros que faltan se piden en la otra sede, porque aquí no hay sitio para todos.",
    )),
    ("prose", (
        "notes from the meeting in the small room on the second floor\nwe agreed that the old plan was too slow for the new machines\nthe group will meet again when the figures are in",
        "il treno era in ritardo e nessuno sapeva il perché di tanta attesa\nalla fine abbiamo preso la corriera per tornare a casa con gli altri",
    )),
    ("prose", (
        "Notwithstanding methodological heterogeneity, longitudinal investigations demonstrate considerable interindividual variability. Subsequent operationalisation necessitates interdisciplinary collaboration.",
        "Поезд опять опоздал, и никто не знал почему. Вечером мы сели в автобус и приехали домой очень поздно.",
    )),
    ("list", ("- red apples\n- two lemons\n- flour\n- a loaf of bread\n- some butter\n- green tea", "1. der Hammer\n2. die Säge\n3. zwei Schrauben\n4. ein Seil\n5. die Leiter", "* [[the old mill]]\n* [[the ferry]]\n* [[a lighthouse]]\n* [[two bridges]]\n* [[the harbour]]")),
    ("list", ("red apples\ntwo lemons\nthe flour\na loaf of bread\nsome butter\ngreen tea\na jar of honey", "le marteau\nla scie\ndeux vis\nune corde\nl’échelle\nles clous", "<ul>\n<li>the ferry</li>\n<li>a lighthouse</li>\n<li>two bridges</li>\n<li>the harbour</li>\n</ul>")),
    ("table", ("name\tsize\tprice\nlamp\t12\t40.5\nchair\t80\t99.0\ntable\t120\t310", "| town | people |\n|---|---|\n| Altdorf | 5120 |\n| Bergen | 901 |\n| Celle | 77 |", "id,colour,count,share\n1,red,20,0.2\n2,blue,35,0.35\n3,green,45,0.45")),
    ("table", ("{|\n! town !! people !! since\n|-\n| the old port || 5120 || 1806\n|-\n| the mill || 901 || 1910\n|}", "<table><tr><td>the lamp</td><td>12</td></tr><tr><td>a chair</td><td>80</td></tr><tr><td>the desk</td><td>120</td></tr></table>")),
    ("junk", ("xkqzv wrtplk bbvcn zzkqpw mnrtvb qqwrtz kjhgfd lkmnbv trwqzx", "3f9a77c1 00be45d2 9c1d22ef 77aa01b3 5d5d5d5d 19ce00af", "aGVsbG8gd29ybGQhIHRoaXM+aXMgYmFzZTY0\nZGF0YQ+mb3IgdGhlIGV4YW1wbGUgb25seQ1z")),
    ("junk", ("Home | Login | About us | Search | Top", "Menu\nHome\nLogin\nShare\nNext page\nOlder\nNewer", "cat tree cat tree tree house cat tree house house cat tree cat tree house cat", "#@!? ^^%: ;;.. ~~!! ==+: %%^^ ;:;: ?!?!")),
)


class Mixture:
    """A fitted mixture: standardization, components with diagonal variances, and the kind of each component."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray, kinds: list[str]):
        self.centre, self.scale, self.weights, self.means, self.variances, self.kinds = centre, scale, weights, means, variances, kinds
        self.pure = np.ones(len(kinds), dtype=bool)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(component probabilities of each row, log likelihood of each row); x holds raw statistics."""
        z = (x - self.centre) / self.scale
        inverse = 1 / self.variances
        log = -0.5 * ((z * z) @ inverse.T - 2 * z @ (self.means * inverse).T + (self.means**2 * inverse).sum(1) + np.log(self.variances).sum(1)) + np.log(self.weights)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0] - 0.5 * x.shape[1] * np.log(2 * np.pi)


def start_mixture(centre: np.ndarray, scale: np.ndarray) -> Mixture:
    """Components at the inspected examples."""
    means, spread_ = [], []
    for _, texts in EXAMPLES:
        z = (np.array([statistics(t)[1:] for t in texts]) - centre) / scale
        means.append(z.mean(0))
        spread_.append(np.maximum(z.var(0), 0.5))
    k = len(EXAMPLES)
    return Mixture(centre, scale, np.full(k, 1 / k), np.array(means), np.array(spread_), [kind for kind, _ in EXAMPLES])


def _sums(df: DataFrame, make) -> dict[int, float]:
    """Totals by index of what ``make()(matrix of statistics) -> vector`` gives for each batch; added up on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, total = make(), None
        for b in batches:
            if b.num_rows:
                v = f(np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": np.arange(len(total)), "v": total})

    out = df.select(*USED).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # one row for each parameter
    return {r.k: r.v for r in out}


def fit_mixture(stats: DataFrame, max_iterations: int = 12, tolerance: float = 1e-3) -> Mixture | None:
    """Expectation-maximization over all rows of ``stats``; None where there are none.

    An iteration is one pass: every task sums responsibilities, their first and second moments and the log likelihood
    over its rows, and only these few hundred numbers meet.
    """
    d = len(USED)
    moments = _sums(stats, lambda: lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not moments or not moments[0]:
        return None
    n = moments[0]
    centre = np.array([moments[1 + i] for i in range(d)]) / n
    scale = np.sqrt(np.maximum(np.array([moments[1 + d + i] for i in range(d)]) / n - centre**2, 1e-4))
    m = start_mixture(centre, scale)
    k, before = len(m.kinds), -np.inf
    for _ in range(max_iterations):

        def make(m: Mixture = m):
            def f(x: np.ndarray) -> np.ndarray:
                r, ll = m.responsibilities(x)
                z = (x - m.centre) / m.scale
                return np.concatenate([[ll.sum()], r.sum(0), (r.T @ z).ravel(), (r.T @ (z * z)).ravel()])

            return f

        s = _sums(stats, make)
        s = np.array([s[i] for i in range(1 + k + 2 * k * d)])
        mass = s[1 : 1 + k]
        fed = mass > 1e-6
        means, variances = m.means.copy(), m.variances.copy()
        means[fed] = s[1 + k : 1 + k + k * d].reshape(k, d)[fed] / mass[fed, None]
        variances[fed] = np.maximum(s[1 + k + k * d :].reshape(k, d)[fed] / mass[fed, None] - means[fed] ** 2, LEAST_VARIANCE)
        m = Mixture(centre, scale, np.maximum(mass / n, 1e-9), means, variances, m.kinds)
        if s[0] / n - before < tolerance:
            break
        before = s[0] / n
    x = [np.array([statistics(t)[1:] for t in texts]) for _, texts in EXAMPLES]
    votes = np.zeros((k, len(KINDS)))  # components named by the examples that they now explain
    for (kind, _), rows in zip(EXAMPLES, x, strict=True):
        votes[:, KINDS.index(kind)] += m.responsibilities(rows)[0].sum(0)
    m.kinds = [KINDS[int(v.argmax())] if v.sum() > 0.2 else old for v, old in zip(votes, m.kinds, strict=True)]
    m.pure = (m.means * m.scale + m.centre)[:, [USED.index(f"{x}_share") for x in ("prose", "list", "table", "odd")]].max(1) >= PURE
    return m


def most_words(s: tuple[float, ...]) -> str:
    """What most of the document's own words are: prose from one half on, else the largest of the other shares."""
    own = dict(zip(STATS, s, strict=True))
    shares = {"list": own["list_share"], "table": own["table_share"], "junk": own["odd_share"]}
    return "prose" if own["prose_share"] >= 0.5 else max(shares, key=shares.get)


def decide(model: Mixture, x: np.ndarray) -> list[str]:
    """The kind of each row of STATS: the most probable one, probabilities of pure components of one kind being added."""
    by = model.responsibilities(x[:, 1:])[0] @ np.array([[float(kind == k and pure) for k in KINDS] for kind, pure in zip(model.kinds, model.pure, strict=True)])
    return [KINDS[j] if p >= SURE else most_words(tuple(row)) for j, p, row in zip(by.argmax(1), by.max(1), x, strict=True)]


_OUT = pa.schema([("doc_id", pa.int64())] + [(n, pa.float64()) for n in STATS])


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every text; null and blank texts give a row of nulls, and repeated rows repeat."""

    def make():
        def f(ids: list, texts: list) -> dict:
            rows = [statistics(t) or (None,) * len(STATS) for t in texts]
            return {"doc_id": ids} | dict(zip(STATS, zip(*rows, strict=True), strict=True))

        return f

    return map_texts(df, id_col, text_col, _OUT, "doc_id long, " + ", ".join(f"{n} double" for n in STATS), make)


def shapes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_statistics with the ``kind`` of each text; null for null or blank texts, which shape no component."""
    stats = materialize(text_statistics(df, id_col, text_col))
    model = fit_mixture(stats.filter("words is not null"))
    if model is None:
        return stats.withColumn("kind", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in STATS]) if b.num_rows else np.zeros((0, len(STATS)))
            known = ~np.isnan(x[:, 0])
            kinds: list[str | None] = [None] * len(x)
            if known.any():
                for i, kind in zip(np.flatnonzero(known), decide(model, x[known]), strict=True):
                    kinds[i] = kind
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string())], names=[*b.schema.names, "kind"])

    return stats.mapInArrow(run, stats.schema.simpleString()[7:-1].replace(":", " ") + ", kind string")


def kind_of(text: str | None) -> str | None:
    """The kind of one text by its own word shares alone, for operators that set lists, tables and junk aside."""
    s = statistics(text)
    return None if s is None else most_words(s)
