"""Evaluation items leaking into training text.

Method: one Aho-Corasick automaton over the normalised items (every run of ANCHOR_WORDS of their words) scans each
normalised text once; hits near one diagonal propose a passage, whose words are then aligned exactly with the item's,
and word offsets lead back to characters of the original text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.encoding import offset_before, repair_spans
from textquarry.runtime import map_texts

#: Consecutive words that make an anchor.
ANCHOR_WORDS = 3
#: Share of an item's words that a passage must hold, in order.
LEAST_SHARE = 0.5
#: Share that the rare words must keep, within the part of the item that the passage covers: names and figures tell an
#: item from others of like build.
LEAST_RARE = 0.5
#: Characters of all items together that are sent to the tasks.
MOST_ITEM_CHARS = 20_000_000

_WORD = re.compile(r"[^\W_]+")
_DROP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:amp;)?lt;/?[A-Za-z](?:[^<>&]|&(?!(?:amp;)?[lg]t;))*&(?:amp;)?gt;|&#?\w{2,31};|\\[A-Za-z]+\*?|\]\([^()\s]*\)", re.S)
_MARKED = re.compile(r"[<&\\\]]")
_SENTENCE = re.compile(r"[^.?!]+[.?!]*")


def item_words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Items:
    """The items as words, their anchors in one automaton, and how rare each word is among them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = sorted((int(i), t) for i, t in items if i is not None and t and t.strip())
        self._ready = False

    def __reduce__(self):
        return Items, (self.items,)

    def prepare(self) -> None:
        if self._ready:
            return
        opening = Counter(tuple(item_words(s)) for _, t in self.items for s in _SENTENCE.findall(t)[:1])
        shared = {s for s, n in opening.items() if n > max(2, 0.02 * len(self.items))}  # an instruction before many items
        self.words: dict[int, list[str]] = {}
        self.length: dict[int, int] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        seen: Counter = Counter()
        for i, t in self.items:
            ws = item_words(t)
            first = tuple(item_words((_SENTENCE.findall(t) or [""])[0]))
            skip = len(first) if first in shared and len(first) < len(ws) else 0
            self.words[i] = ws[skip:]
            self.length[i] = len(ws)
            seen.update(set(ws))
            for k in range(len(ws) - skip - ANCHOR_WORDS + 1):
                places[" " + " ".join(ws[skip + k : skip + k + ANCHOR_WORDS]) + " "].append((i, k))
        n = max(1, len(self.items))
        self.rarity = {w: math.log((n + 1) / c) for w, c in seen.items()}
        self.automaton = ahocorasick.Automaton()
        for a, at in places.items():
            self.automaton.add_word(a, (len(a), at))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)
        self._ready = True


def align(item: list[str], words: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence as (place in the item, place in the words)."""
    n, m = len(item), len(words)
    table = [[0] * (m + 1)]
    for a in item:
        above, row, left = table[-1], [0], 0
        for j, b in enumerate(words):
            left = above[j] + 1 if a == b else max(left, above[j + 1])
            row.append(left)
        table.append(row)
    out, i, j = [], n, m
    while i and j:
        if item[i - 1] == words[j - 1] and table[i][j] == table[i - 1][j - 1] + 1:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The aligned places without stragglers: cut where the text runs on for longer than the item misses words."""
    runs: list[list[tuple[int, int]]] = [[]]
    for p in pairs:
        if runs[-1] and p[1] - runs[-1][-1][1] > 6 + 1.5 * (p[0] - runs[-1][-1][0]):
            runs.append([])
        runs[-1].append(p)
    return max(runs, key=len)


def leaks(items: Items, text: str | None) -> list[tuple[int, float, int, int]]:
    """(item, share of its words, start, end in the text as given) for every item that leaks into it; null gives none."""
    if not text or not items.any:
        return []
    replaced: list[list[tuple[int, int, int]]] = []
    if not text.isascii():
        (_, text, *_), replaced = repair_spans(text)
    if _MARKED.search(text):
        text = _DROP.sub(lambda m: " " * len(m.group()), text)
    words = [w.lower() for w in _WORD.findall(text)]
    if len(words) < ANCHOR_WORDS:
        return []
    flat = " " + " ".join(words) + " "
    hits = [(end, n, at) for end, (n, at) in items.automaton.iter(flat)]
    if not hits:
        return []
    starts, p = [], 1
    for w in words:
        starts.append(p)
        p += len(w) + 1
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for end, n, at in hits:
        j = bisect_right(starts, end - n + 2) - 1
        for i, k in at:
            near[i].append((j - k, j))
    out = []
    spans = None
    for i, found in near.items():
        item, whole = items.words[i], items.length[i]
        if len({j for _, j in found}) < 2:
            continue
        found.sort()
        best = None
        done = None
        for diagonal, _ in found:  # below 0 where the text opens inside the item
            if done is not None and diagonal <= done:
                continue
            done = diagonal + max(8, len(item) // 3)  # one window covers near diagonals
            a = max(0, diagonal - len(item) // 4 - 4)
            window = words[a : max(a, done + len(item) + len(item) // 4 + 4)]
            pairs = densest(align(item, window))
            if not pairs:
                continue
            share = len(pairs) / whole
            if best is None or share > best[0]:
                best = (share, pairs, a)
        if best is None:
            continue
        share, pairs, a = best
        covered = item[pairs[0][0] : pairs[-1][0] + 1]
        total = sum(items.rarity[w] for w in covered)
        kept = sum(items.rarity[item[x]] for x, _ in pairs)
        rare = [w for w in covered if items.rarity[w] > math.log((len(items.items) + 1) / (0.03 * len(items.items) + 1.5))]
        matched = Counter(item[x] for x, _ in pairs)
        rare_kept = sum(min(c, matched[w]) for w, c in Counter(rare).items()) / len(rare) if rare else 1.0
        if share >= LEAST_SHARE and rare_kept >= LEAST_RARE and kept >= LEAST_RARE * total:
            if spans is None:
                spans = [m.span() for m in _WORD.finditer(text)]
            s, e = spans[a + pairs[0][1]][0], spans[a + pairs[-1][1]][1]
            out.append((i, share, offset_before(replaced, s), offset_before(replaced, e, end=True)))
    return sorted(out)


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def leaked_items(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, share, start, end of every leak. Null and blank texts and items give none; repeated rows repeat.

    The items are collected and sent to the tasks: an evaluation set is given by hand and fixed, whatever the corpus. Its
    size is checked before: beyond MOST_ITEM_CHARS it must be searched for in parts, each a table of its own.
    """
    chars = benchmark.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    if chars > MOST_ITEM_CHARS:
        raise ValueError(f"evaluation items of {chars} characters; give them in parts of at most {MOST_ITEM_CHARS}")
    items = Items([(r[0], r[1]) for r in benchmark.select(item_col, item_text).filter(f"{item_text} is not null").collect()])
    shared = df.sparkSession.sparkContext.broadcast(items)

    def make():
        known = shared.value
        known.prepare()

        def f(ids: list, texts: list) -> dict:
            rows = [(i, *x) for i, t in zip(ids, texts, strict=True) for x in leaks(known, t)]
            return {n: [r[k] for r in rows] for k, n in enumerate(_OUT.names)}

        return f

    return map_texts(df, id_col, text_col, _OUT, "doc_id long, item_id long, share double, start long, end long", make)
