"""Markup residue: which kinds a text carries, and clean text that keeps its structure.

Method for HTML: composite text density. For every node of the document tree the characters per tag, adjusted by the
share of links, give a density; the densities of a node's children are summed, and the subtree of the largest sum is the
content. The smallest density on the path from the body to it is the threshold: of every other node that reaches it, the
subtree of the largest sum is content too, and what is in none of them is left out.
Markdown, wiki markup and LaTeX are read by patterns. All four come out in one plain form: ``# `` before headings,
``- `` before entries, fenced code, cells between bars, formulas between dollars.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from textquarry.llm.shape import kind_of
from textquarry.runtime import map_texts

#: Names of HTML elements.
TAGS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
_GONE = frozenset("script style noscript template head iframe svg object".split())
_STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl table pre".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul caption title".split())
_CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
for _t in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article"):
    _CLOSES[_t] = ("p",)

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*|/)?)>")
_COMMENT = re.compile(r"<!--.*?(?:-->|$)|<!DOCTYPE[^>]*>|<!\[CDATA\[|<\?xml[^>]*>", re.S | re.I)
_REFERENCE = re.compile(r"&(#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_ESCAPED_TAG = re.compile(r"&(?:amp;)?lt;(/?[A-Za-z][A-Za-z0-9]*(?:\s(?:[^<>&]|&(?!(?:amp;)?[lg]t;))*)?/?)&(?:amp;)?gt;", re.S)
_BLANKS = re.compile(r"[\u00a0\u2007\u202f]")
_ESCAPED_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9]*)")


# ---- HTML --------------------------------------------------------------------------------------------


class Node:
    __slots__ = ("chars", "children", "content", "density", "link_chars", "link_tags", "name", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.children = name, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.content = False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.open: Counter = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in TAGS:
            self.at.children.append(self.get_starttag_text() or "")
            return
        for _ in range(3):
            if self.at.name in _CLOSES.get(tag, ()) and self.at.parent:
                self.open[self.at.name] -= 1
                self.at = self.at.parent
        node = Node(tag, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in TAGS:
            self.at.children.append(Node(tag, self.at))
        else:
            self.at.children.append(self.get_starttag_text() or "")

    def handle_endtag(self, tag: str) -> None:
        while self.open[tag] > 0:  # each step closes a node, so that stray end tags cost nothing
            name = self.at.name
            self.open[name] -= 1
            self.at = self.at.parent
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree_of(text: str) -> Node:
    parser = _Tree()
    parser.feed(text)
    parser.close()
    return parser.root


def _nodes(root: Node) -> list[Node]:
    """Every node, parents first; without recursion."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if isinstance(c, Node))
    return order


def box(root: Node) -> None:
    """Runs of words and inline tags beside blocks become nodes of their own, as a browser boxes them."""
    for n in _nodes(root):
        if n.name in _GONE or not any(isinstance(c, Node) and c.name in _BLOCK for c in n.children):
            continue
        out: list = []
        for c in n.children:
            if (isinstance(c, Node) and (c.name in _BLOCK or c.name in _GONE)) or (isinstance(c, str) and not c.strip()):
                out.append(c)
                continue
            if not (out and isinstance(out[-1], Node) and out[-1].name == "#run"):
                out.append(Node("#run", n))
            out[-1].children.append(c)
            if isinstance(c, Node):
                c.parent = out[-1]
        n.children = out


def measure(root: Node) -> None:
    """Characters, tags and links of every subtree, then densities and their sums."""
    order = _nodes(root)
    for n in reversed(order):
        if n.name in _GONE:
            continue
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(c.strip())
            else:
                n.chars += c.chars
                n.tags += c.tags + (c.name != "#run")
                n.link_chars += c.chars if c.name == "a" else c.link_chars
                n.link_tags += c.link_tags + (c.name == "a")
    ratio = root.link_chars / max(root.chars, 1)
    for n in order:
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        if n.name in _GONE or not c:
            n.density = 0.0
            continue
        base = math.log(c / max(c - n.link_chars, 1) * n.link_chars + ratio * c + math.e)
        n.density = c / t * max(0.0, math.log(max(c / lc * t / lt, 1.0001)) / max(base, 1.0))
    for n in order:
        n.sum = sum(c.density for c in n.children if isinstance(c, Node)) or n.density  # a leaf is all there is of it


def _largest(root: Node) -> dict[int, Node]:
    """For every node the one of the largest density sum in its subtree, itself included; of equals the outer one."""
    best: dict[int, Node] = {}
    for n in reversed(_nodes(root)):
        top = n
        for c in n.children:
            if isinstance(c, Node) and c.name not in _GONE and best[id(c)].sum > top.sum:
                top = best[id(c)]
        best[id(n)] = top
    return best


def mark_content(root: Node) -> tuple[Node, float]:
    """Marks the content; (the subtree of the largest density sum, the threshold on the path from the body to it).

    A text with words outside all tags is no page but a writer's text with some tags in it, and all of it is content.
    Headings, lists, tables and code that are not mostly links are kept wherever they stand, as the structure of the text.
    """
    if any(isinstance(c, str) and c.strip() or isinstance(c, Node) and c.name == "#run" and c.link_chars <= 0.5 * c.chars for c in root.children):
        root.content = True
        return root, root.density
    largest = _largest(root)
    best = largest[id(root)]
    threshold, n = best.density, best
    while n := n.parent:
        threshold = min(threshold, n.density)
    stack = [root]
    while stack:
        n = stack.pop()
        if n.name in _GONE or not n.chars:
            continue
        if n.density >= threshold:
            largest[id(n)].content = True
        if n.name in _STRUCTURE and n.link_chars <= 0.5 * n.chars:
            n.content = True
        if not n.content:
            stack.extend(c for c in n.children if isinstance(c, Node))
    return best, threshold


def render(node: Node) -> str:
    """Clean text of the content that is marked in a subtree."""
    out: list[str] = []

    def inline(n: Node) -> str:
        return re.sub(r"\s+", " ", _raw(n)).strip()

    stack: list[tuple[Node | str, int, bool]] = [(node, 0, False)]
    while stack:
        n, depth, kept = stack.pop()
        if isinstance(n, str):
            # between blocks of a fragment, line breaks are the writer's own
            if kept:
                out.append(re.sub(r"[ \t\r\f]+", " ", n) if depth <= 1 and n.count("\n") and n.strip() else re.sub(r"\s+", " ", n))
            continue
        kept = kept or n.content
        if n.name in _GONE:
            continue
        if not kept or n.name == "#run":
            if not kept and n.name in _BLOCK:
                out.append("\n\n")
            stack.extend((c, depth + (n.name != "#run"), kept) for c in reversed(n.children))
        elif n.name == "br":
            out.append("\n")
        elif n.name == "hr":
            out.append("\n\n")
        elif len(n.name) == 2 and n.name[0] == "h" and n.name[1].isdigit():
            out.append(f"\n\n{'#' * int(n.name[1])} {inline(n)}\n\n")
        elif n.name == "pre":
            code = _raw(n).strip("\n")
            out.append(f"\n\n```\n{code}\n```\n\n")
        elif n.name == "tr":
            cells = [inline(c) for c in n.children if isinstance(c, Node) and c.name in ("td", "th")]
            out.append("\n" + " | ".join(cells) if cells else "\n" + inline(n))
        else:
            mark = "\n- " if n.name in ("li", "dd") else "\n\n" if n.name in _BLOCK else "`" if n.name in ("code", "tt") else ""
            close = "`" if mark == "`" else "\n\n" if n.name in _BLOCK and n.name not in ("li", "dd") else ""
            out.append(mark)
            stack.append((close, 2, True) if not close.strip() else ("`", 2, True))
            stack.extend((c, depth + 1, True) for c in reversed(n.children))
    return _tidy("".join(out))


def _raw(node: Node) -> str:
    """All text of a subtree as it stands, breaks as line ends; without recursion."""
    out, stack = [], list(reversed(node.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.name == "br":
            out.append("\n")
        elif n.name not in _GONE:
            stack.extend(reversed(n.children))
    return "".join(out)


def has_html(text: str) -> bool:
    """Tags of known names, comments, or character references, also when escaped."""
    if "<" in text and (any(m.group(2).lower() in TAGS for m in _TAG.finditer(text)) or _COMMENT.search(text)):
        return True
    return "&" in text and any(m.group(1)[0] == "#" or m.group(1) + ";" in html5 for m in _REFERENCE.finditer(text))


def from_html(text: str) -> str:
    """Clean text of HTML; escaped tags are read as tags."""
    if "lt;" in text:
        text = _ESCAPED_TAG.sub(lambda m: f"<{m.group(1)}>" if _ESCAPED_NAME.match(m.group(1)).group(1).lower() in TAGS else m.group(), text)
    if not (any(m.group(2).lower() in TAGS for m in _TAG.finditer(text)) or _COMMENT.search(text)):
        return _BLANKS.sub(" ", html.unescape(text))
    # a sign that opens no tag stays a sign
    text = re.sub(r"<(?![A-Za-z/!?])", "&lt;", text)
    root = tree_of(_COMMENT.sub("", text))
    box(root)
    measure(root)
    mark_content(root)
    return _BLANKS.sub(" ", render(root))


# ---- the others --------------------------------------------------------------------------------------

_LATEX = re.compile(
    r"\\(?:begin|end)\{[A-Za-z]+\*?\}|(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|~\\[a-z]+\{|\\(?:item|hline|maketitle|tableofcontents|noindent|newline|par|centering|toprule|midrule|bottomrule)\b"
    r"|\\\((?:(?!\\[()])[^\n])+\\\)|\\\[(?:(?!\\[\[\]])[^\n])+\\\]|\$\$[^$]+\$\$|(?<![\w$])\$(?=[^\s$])(?=[^$\n\\^_]*[\\^_])[^$\n]*(?<=[^\s$])\$(?![\w$])|(?<=\S)~?\\(?:cite|ref|label|footnote)\b"
)
_WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|^\{\|.*$|^\|\}|^\|-\s*$|^={2,6}[^=\n].*?[^=\n]?={2,6}[ \t]*$|'''?[^'\n]+?'''?(?!')|\[(?:https?:)?//[^\s\]]+ [^\]\n]+\]|^#REDIRECT\b|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|</?(?:ref|nowiki|references|gallery)\b[^>]*>",
    re.M,
)
_MARKDOWN = re.compile(
    r"^ {0,3}#{1,6}[ \t]+(?!\[\[)\S|(?<![\w*\\])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?!\*)|(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w)|(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])"
    r"|!?\[[^\]\[\n]*\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:\s+\"[^\"\n]*\")?\)|^ {0,3}(?:```|~~~)|(?<!`)`[^`\n]+`(?!`)|~~(?=\S)[^~\n]+(?<=\S)~~|^ {0,3}>[ \t]+\S|^\S[^\n]*\n={3,}[ \t]*$|^[^\s|\-+][^\n|]*\n-{3,}[ \t]*$|^\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$"
    r"|^\[[^\]\n]+\]:[ \t]+\S+|\[\^[\w-]+\]|<https?://[^\s>]+>|^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]",
    re.M,
)
_ANY = re.compile(r"[<&`#*_\[\\$~>'={|-]")


def from_latex(text: str) -> str:
    text = re.sub(r"(?<!\\)%[^\n]*", "", text) if "\\begin{document}" in text else text
    text = re.sub(r"\\(?:label|cite[tp]?|ref|footnote|index|vspace|hspace)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text.replace("~\\", "\\"))
    text = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}(?:\[[^\]]*\])?\n?(.*?)\n?\\end\{(?:verbatim|lstlisting)\}", r"\n```\n\1\n```\n", text, flags=re.S)
    text = re.sub(r"\\begin\{(?:equation|align|displaymath|math|eqnarray|gather)\*?\}\s*(.*?)\s*\\end\{(?:equation|align|displaymath|math|eqnarray|gather)\*?\}", lambda m: f"$${m.group(1)}$$", text, flags=re.S)
    text = re.sub(r"\\\((.*?)\\\)", lambda m: f"${m.group(1)}$", text)
    text = re.sub(r"\\\[(.*?)\\\]", lambda m: f"$${m.group(1)}$$", text, flags=re.S)

    def table(m: re.Match) -> str:
        rows = [r for r in re.split(r"\\\\|\\hline|\\(?:top|mid|bottom)rule", m.group(1)) if r.strip()]
        return "\n" + "\n".join(" | ".join(c.strip() for c in r.split("&")) for r in rows) + "\n"

    text = re.sub(r"\\begin\{tabular\}(?:\[[^\]]*\])?\{[^}]*\}(.*?)(?:\\end\{tabular\}|$)", table, text, flags=re.S)
    for n, name in enumerate(("section", "subsection", "subsubsection"), 1):
        text = re.sub(rf"\\{name}\*?\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", lambda m, n=n: f"\n{'#' * n} {m.group(1)}\n", text)
    text = re.sub(r"\\item\b\s*(?:\[[^\]]*\])?\s*", "- ", text)
    text = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\]|\{[^}]*\})?", "", text)
    # stress around a formula leaves a formula, around words it leaves the words
    text = re.sub(r"\\(?:emph|text[a-z]{2})\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}", lambda m: f"${m.group(1)}$" if re.search(r"[\\^_]", m.group(1)) else m.group(1), text)
    formulas: list[str] = []
    text = re.sub(r"\$\$.*?\$\$|\$[^$\n]+\$", lambda m: formulas.append(m.group()) or f"\x00{len(formulas) - 1}\x00", text, flags=re.S)
    for _ in range(4):
        text = re.sub(r"(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\(?:noindent|newline|par|centering|maketitle|tableofcontents|hline)\b", "", text).replace("\\%", "%").replace("\\&", "&").replace("\\_", "_").replace("\\\\\n", "\n")
    return re.sub("\x00(\\d+)\x00", lambda m: formulas[int(m.group(1))], text)


def from_wiki(text: str) -> str:
    text = re.sub(r"<ref[^>/]*>.*?</ref>|<ref[^>]*/>|__[A-Z]+__", "", text, flags=re.S)
    text = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei|Categoría|Archivo|Catégorie|Fichier|Categoria|Categorie|Bestand|Категория|Файл):[^\]]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?:)?//\S+ ([^\]\n]+)\]", r"\1", text)
    for _ in range(3):
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)

    def table(m: re.Match) -> str:
        rows = []
        for part in re.split(r"^\|-.*$", m.group(1), flags=re.M):
            cells = [c.strip() for ln in part.splitlines() if ln and ln[0] in "|!" and ln[:2] not in ("|}", "|+") for c in re.split(r"\|\||!!", ln[1:])]
            if cells:
                rows.append(" | ".join(cells))
        return "\n".join(rows)

    text = re.sub(r"^\{\|[^\n]*\n(.*?)(?:^\|\}|\Z)", table, text, flags=re.S | re.M)
    text = re.sub(r"^(={1,6})\s*([^=\n].*?)\s*={1,6}[ \t]*$", lambda m: f"{'#' * max(1, len(m.group(1)) - 1)} {m.group(2)}", text, flags=re.M)
    text = re.sub(r"^[*#]+\s*", lambda m: m.group() if m.group().strip("# ") == "" and m.group().endswith(" ") and not m.group().startswith("#[") else "- ", text, flags=re.M)
    return re.sub(r"'{2,5}", "", text)


def from_markdown(text: str) -> str:
    parts = re.split(r"(^ {0,3}(?:```|~~~)[^\n]*\n.*?(?:^ {0,3}(?:```|~~~)[ \t]*$|\Z))", text, flags=re.S | re.M)
    for i in range(0, len(parts), 2):
        t = parts[i]
        t = re.sub(r"^(\S[^\n]*)\n={3,}[ \t]*$", r"# \1", t, flags=re.M)
        t = re.sub(r"^([^\s|\-+][^\n|]*)\n-{3,}[ \t]*$", r"## \1", t, flags=re.M)
        t = re.sub(r"!\[([^\]\[\n]*)\]\([^)]*\)", r"\1", t)
        t = re.sub(r"\[([^\]\[\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:\s+\"[^\"\n]*\")?\)", r"\1", t)
        t = re.sub(r"^\[[^\]\n]+\]:[ \t]+\S+[^\n]*\n?|\[\^[\w-]+\]:?", "", t, flags=re.M)
        t = re.sub(r"<(https?://[^\s>]+)>", r"\1", t)
        t = re.sub(r"^\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\n?", "", t, flags=re.M)
        t = re.sub(r"^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", t, flags=re.M)
        t = re.sub(r"(?<![\w*\\])(\*{1,3})(?=\S)([^*\n]+?)(?<=\S)\1(?!\*)", r"\2", t)
        t = re.sub(r"(?<!\w)(_{1,2})(?=[^\s_])([^_\n]+?)(?<=[^\s_])\1(?!\w)", r"\2", t)
        t = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", t)
        t = re.sub(r"^ {0,3}>[ \t]?", "", t, flags=re.M)
        parts[i] = re.sub(r"^([ \t]*)[*+][ \t]+", r"\1- ", t, flags=re.M)
    return "".join(parts)


def _tidy(text: str) -> str:
    """Blank lines and blanks in excess, outside fenced code."""
    parts = re.split(r"(```\n.*?\n```)", text, flags=re.S)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]{2,}", " ", parts[i])))
    return "".join(parts).strip()


def convert(text: str | None) -> tuple[list[str], str | None]:
    """(kinds of markup in the text, the text without it). Null gives no kinds and null; junk is left as it is."""
    if not text or not _ANY.search(text):
        return [], text
    page = has_html(text)
    # references and tags are read first: what other markup they hide is judged on what is left
    bare = text
    if page and "<" in text:
        bare = re.sub(r"(?is)<(style|script)\b.*?(?:</\1\s*>|$)|<pre\b.*?(?:</pre>|$)", " ", _COMMENT.sub(" ", text))
        bare = _TAG.sub(lambda m: " " if m.group(2).lower() in TAGS else m.group(), bare)
    outside = re.sub(r"^ {0,3}(```|~~~).*?(?:^ {0,3}\1[ \t]*$|\Z)", "\n", bare, flags=re.S | re.M) if "```" in bare or "~~~" in bare else bare
    wiki = bool(_WIKI.search(outside))
    latex = "\\" in outside or "$" in outside
    latex = latex and bool(_LATEX.search(outside))
    rest = _LATEX.sub(" ", outside) if latex else outside
    if latex:
        rest = re.sub(r"\$\$.*?\$\$|\$[^$\n]+\$|\\begin\{(equation|tabular|verbatim|lstlisting|align)\*?\}.*?(?:\\end\{\1\*?\}|\Z)", " ", outside, flags=re.S)
    markdown = bool(_MARKDOWN.search(rest)) or outside is not bare
    kinds = [k for k, there in (("html", page), ("markdown", markdown), ("wiki", wiki), ("latex", latex)) if there]
    if not kinds or kind_of(text) == "junk":
        return [], text
    clean = text
    if latex:
        clean = from_latex(clean)
    if wiki:
        clean = from_wiki(clean)
    if page:
        clean = from_html(clean)
    if markdown:
        clean = from_markdown(clean)
    return kinds, _tidy(clean)


_OUT = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("clean", pa.string())])


def clean_markup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kinds, clean of every text; kinds is empty and clean the text itself where there is no markup.

    Null text gives no kinds and null; repeated rows repeat; other columns are ignored; an empty table gives none.
    """

    def make():
        def f(ids: list, texts: list) -> dict:
            rows = [convert(t) for t in texts]
            return {"doc_id": ids, "kinds": [r[0] for r in rows], "clean": [r[1] for r in rows]}

        return f

    return map_texts(df, id_col, text_col, _OUT, "doc_id long, kinds array<string>, clean string", make)
