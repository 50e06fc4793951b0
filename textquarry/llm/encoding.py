"""Garbled text from wrong character encodings: find the damaged spans and put the original back.

Method: for every (written-as, read-as) pair of encodings the garbled sequence of each character is computed
beforehand, all sequences go into one Aho-Corasick automaton, and only matched spans are replaced. Between
single-byte encodings a character garbles to one character that may be sound elsewhere; there the automaton
holds garbled pairs of letters and whole words are replaced only when the decoded reading is more natural.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.runtime import map_texts

#: Code pages that UTF-8 bytes were read under.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250")
#: Fixed values: (written as, read as) between single-byte encodings, both for Cyrillic text.
SINGLE = (("cp1251", "latin-1"), ("cp1251", "mac_roman"), ("koi8_r", "latin-1"), ("cp866", "latin-1"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"))
#: Frequent pairs of letters of Russian.
PAIRS = "ст то но на по ен ни не ко ра ов ро го ал пр ли ре ос во ка ер от ол ор та ва ет ло ел ны ит ри ть ат ес де ла ом те од ле ий ск ве им ан да ар ог ас бо до до ма ви ил ть ся ки ль ме ие мо со об ак за ем ин тр из ты ый ую ых же ми пи ше че ег ук ис ус ап чт сл ов св му сч са вс".split()
#: Words of a sentence that speaks about a character instead of using it.
ABOUT = re.compile(r"\b(mark|sign|symbol|character|glyph|means?|meant|stands for|turns into|shows how|looks like|reads as|example|garbled|code point|zeichen|signo|signe|segno|caractère|carácter|carattere|caractere|teken|знак|символ)\b", re.I)
#: Accented letters of Western European languages.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ"
LOST = "�"
_DASH = set("–—…•·«»-→−×≥≤≠€©®™")
_SUSPECT = re.compile("[\u0080-\u009f¡-¿À-ɏͰ-ӿ‐-⯿ﬁﬂ�]")
#: What words garbled between single-byte encodings have somewhere: letters that no sound word joins.
_THREE = re.compile("[\u0080-\u009fÀ-ÿ]{3}")
_SWAPPED = re.compile("[а-яё][А-ЯЁ]|[А-Яа-яЁё][│┐└┴┬├─┼╒ё╓-╬]|[│┐└┴┬├─┼╒-╬][А-Яа-яЁё]")
_MAC = re.compile("[†‡·‚„‰ÂÊÁËÈÍÎÏÌÓÔÒÚÛÙıˆ˜¯˘˙˚¸˝˛ˇ]{3}")
_RUNS = re.compile(r"(?<![^\W\d_])(?:[А-Яа-яЁёЂ-Џђ-џҐґ│┐└┴┬├─┼▀▄█▌▐░▒▓⌠■∙√≈≤≥⌡°²·÷═║╒ё╓╔╕╖╗╘╙╚╛╜╝╞╟╠╡Ё╢╣╤╥╦╧╨╩╪╫╬©]+|[\u0080-ÿ]+|[À-ÿŒœŸ†°¢£§•¶ß®©™´¨≠ÆØ∞±≤≥¥µ∂∑∏π∫ªºΩæø¿¡¬√ƒ≈∆«»…ÀÃÕ–—“”‘’÷◊⁄€‹›ﬁﬂ‡·‚„‰ÂÊÁËÈÍÎÏÌÓÔÒÚÛÙıˆ˜¯˘˙˚¸˝˛ˇ]+)(?![^\W\d_])")


def read_bytes(raw: bytes, codec: str) -> str:
    """Bytes as seen under a code page; bytes that it leaves undefined stay as control characters, as browsers do."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def meant_characters() -> list[str]:
    """Characters whose garbled forms are known: Latin supplements, Cyrillic, typographic signs."""
    spans = [(0xA1, 0x17F), (0x391, 0x3C9), (0x401, 0x45F), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2122), (0x2190, 0x2193), (0x2212, 0x2212), (0x2500, 0x2570)]
    return [chr(c) for a, b in spans for c in range(a, b + 1)] + ["\xa0", "﻿"]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Garbled sequence -> {read-as code page: original}; once and twice garbled."""
    found: dict[str, dict[str, str]] = {}
    for c in meant_characters():
        for codec in READ_AS:
            once = read_bytes(c.encode(), codec)
            found.setdefault(once, {}).setdefault(codec, c)
            if codec in ("cp1252", "latin-1", "mac_roman", "cp1251"):
                found.setdefault(read_bytes(once.encode(), codec), {}).setdefault(codec, c)
    found.setdefault("â€", {}).setdefault("cp1252", "”")  # its third byte is a control character that many systems drop
    a = ahocorasick.Automaton()
    for seq, by in found.items():
        a.add_word(seq, (len(seq), by))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _leads() -> re.Pattern:
    """The first two characters of any garbled sequence."""
    words = list(automaton().keys())
    first, second = ("".join(sorted({re.escape(w[k]) for w in words if len(w) > 1})) for k in (0, 1))
    return re.compile(f"[{first}][{second}]")


@lru_cache(maxsize=1)
def pair_automaton() -> ahocorasick.Automaton:
    """Garbled letter pair -> indices into SINGLE; the pair itself -> -1."""
    found: dict[str, list[int]] = {}
    for p in PAIRS:
        for form in {p, p.capitalize(), p.upper()}:
            found.setdefault(form, []).append(-1)
            for k, (w, r) in enumerate(SINGLE):
                if (g := read_bytes(form.encode(w), r)) != form and form != p.upper():
                    found.setdefault(g, []).append(k)
    a = ahocorasick.Automaton()
    for seq, ks in found.items():
        a.add_word(seq, tuple(ks))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def mixed_automaton() -> ahocorasick.Automaton:
    """A plain Latin letter beside the Cyrillic letter that a Western accented letter garbles to -> read-as code pages."""
    found: dict[str, set[str]] = {}
    for read in ("cp1251", "koi8_r", "cp866"):
        for c in ACCENTED:
            g = read_bytes(c.encode("cp1252"), read)
            if "А" <= g <= "я" or g in "Ёё":
                for plain in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
                    for seq in (plain + g, g + plain):
                        found.setdefault(seq, set()).add(read)
    a = ahocorasick.Automaton()
    for seq, by in found.items():
        a.add_word(seq, tuple(sorted(by)))
    a.make_automaton()
    return a


_MIXED = re.compile(r"[^\W\d_]*(?:[A-Za-z][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z])[^\W\d_]*")
_ANY_CYRILLIC = re.compile(r"[А-Яа-яЁё]")
_CYRILLIC_WORD = re.compile(r"(?<![^\W\d_])[А-Яа-яЁё](?![^\W\d_])")


def _mixed(text: str) -> list[tuple[int, int, str, str]]:
    """Words of Latin letters whose accented ones became Cyrillic."""
    words = list(_MIXED.finditer(text))
    if not words:
        return []
    votes = Counter(c for m in words for _, by in mixed_automaton().iter(m.group()) for c in by)
    if not votes:
        return []
    read = max(votes, key=lambda c: (votes[c], c == "cp1251"))
    out = []
    for m in words + (list(_CYRILLIC_WORD.finditer(text)) if len(words) >= 3 else []):
        original = "".join(read_bytes(c.encode(read), "cp1252") if "А" <= c <= "я" or c in "Ёё" else c for c in m.group())
        if all(c.isascii() or c in ACCENTED for c in original):
            out.append((m.start(), m.end(), f"cp1252>{read}", original))
    if read == "cp1251" and len(words) >= 3:  # the opening marks of Spanish
        out += [(m.start(), m.end(), "cp1252>cp1251", {"ї": "¿", "Ў": "¡"}[m.group()]) for m in re.finditer(r"(?<!\w)[їЎ](?=[A-Za-zА-Яа-я])", text)]
    return out


def _weak(seq: str) -> bool:
    """Two letters of one plain alphabet: sound by themselves."""
    return len(seq) == 2 and (all("А" <= c <= "я" or c in "Ёё" for c in seq) or all("À" <= c <= "ÿ" and c.isalpha() for c in seq))


def _spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, code page, original) of multi-character matches, weak ones only inside longer runs."""
    hits = [(end + 1 - n, end + 1, by) for end, (n, by) in automaton().iter_long(text)]
    if not hits:
        return []
    votes = Counter(c for _, _, by in hits for c in by)
    best = sorted(votes, key=lambda c: (-votes[c], READ_AS.index(c)))
    out, run = [], []

    def flush() -> None:
        if any(not _weak(text[s:e]) for s, e, _ in run) or len(run) >= 4:
            for s, e, by in run:
                codec = next(c for c in best if c in by)
                out.append((s, e, codec, by[codec]))

    for h in hits:
        if run and h[0] != run[-1][1]:
            flush()
            run = []
        run.append(h)
    flush()
    return out


def _natural(word: str) -> bool:
    """Cyrillic, in lower case but perhaps for its first letter."""
    return bool(re.fullmatch(r"[А-Яа-яЁё][а-яё]*", word))


def _single_byte(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Words whose single-byte decoding is more natural than they are."""
    hits: dict[int, list[tuple[int, str]]] = {}
    votes: Counter = Counter()
    words = []
    for m in _RUNS.finditer(text):
        w = m.group()
        if any(s < m.end() and m.start() < e for s, e in taken):
            continue
        score = Counter(k for _, ks in pair_automaton().iter(w) for k in ks)
        words.append((m.start(), m.end(), w, score))
        votes.update(score)
    good = [k for k in votes if k >= 0 and votes[k] >= 3 and votes[k] > 1.5 * votes[-1]]
    if not good:
        # a garbled stretch inside sound text: words of which most pairs are garbled
        local = Counter(k for _, _, w, sc in words if sc[-1] == 0 for k in sc if k >= 0 and sc[k] >= 2)
        good = [k for k in local if local[k] >= 2]
        if not good:
            return []
        votes = local
    k = max(good, key=lambda x: votes[x])
    wrote, read = SINGLE[k]
    out = []
    throughout = votes[k] > 3 * votes[-1]
    for s, e, w, score in words:
        if score[k] > score[-1] or (throughout and (score[k] >= score[-1] or not _natural(w))):
            try:
                original = w.encode(read).decode(wrote)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if _natural(original) and (len(w) > 1 or (throughout and original.lower() in "вскиоуая")):
                out.append((s, e, f"{wrote}>{read}", original))
    return out if len(out) >= 2 or any(score[k] >= 2 for _, _, _, score in words) else []


def _quoted(text: str, start: int, end: int, original: str) -> bool:
    """A damaged character that stands alone in a sentence about characters, or alone where its original could not stand."""
    if len(original) > 1:
        return False
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    if not ((before.isspace() or before in "'\"`(“‘«") and (after.isspace() or after in "'\"`),.;:”’»")):
        return False
    a = max(text.rfind(x, 0, start) for x in (". ", "\n", "! ", "? ")) + 1
    b = min((p for x in (". ", "\n", "! ", "? ", "\r") if (p := text.find(x, end)) >= 0), default=len(text))
    return bool(ABOUT.search(text[a:start] + " " + text[end:b])) or (original not in _DASH and original != LOST)


#: A garbled à whose closing no-break space became a plain one.
_PLAIN_BREAK = re.compile("Ã( |$)")


def repair(text: str | None) -> tuple[bool, str | None, int, str, int]:
    """(damaged, text with the originals put back, spans replaced, encodings, characters lost for good).

    Null gives (False, None, 0, '', 0). Examples of damage quoted by sound text are left as they are.
    """
    return repair_spans(text)[0]


def repair_spans(text: str | None) -> tuple[tuple[bool, str | None, int, str, int], list[list[tuple[int, int, int]]]]:
    """What ``repair`` gives, and its replacements in order, as (start, end, length put in) in the text before, one list for each pass."""
    if text is None or text.isascii() or not _SUSPECT.search(text):
        return (False, text, 0, "", 0), []
    spans = _spans(text) if _leads().search(text) else []
    cyrillic = _ANY_CYRILLIC.search(text)
    if _THREE.search(text) or (cyrillic and _SWAPPED.search(text)) or _MAC.search(text):
        spans += _single_byte(text, [(s, e) for s, e, _, _ in spans])
    if not spans and cyrillic and _MIXED.search(text):
        spans = _mixed(text)
    lost = [m.start() for m in re.finditer(LOST, text)]
    sure = [x for x in spans if not _quoted(text, x[0], x[1], x[3])]
    gone = [p for p in lost if not _quoted(text, p, p + 1, LOST)]
    if not sure and not gone:
        return (False, text, 0, "", 0), []
    if len(sure) >= 3:  # a text damaged throughout: single letters standing alone are damaged too
        sure = spans
    out, at = [], 0
    passes: list[list[tuple[int, int, int]]] = [[]]
    for s, e, _, original in sorted(sure):
        if s >= at:
            out += [text[at:s], original]
            passes[0].append((s, e, len(original)))
            at = e
    fixed = "".join(out) + text[at:]
    if any(c in ("cp1252", "latin-1") for _, _, c, _ in sure):  # the no-break space that ends a garbled à often became a plain one
        passes.append([(*m.span(), 1) for m in _PLAIN_BREAK.finditer(fixed)])
        fixed = _PLAIN_BREAK.sub("à", fixed)
    return (True, fixed, len(sure), ",".join(sorted({c for _, _, c, _ in sure})), len(gone)), passes


def offset_before(passes: list[list[tuple[int, int, int]]], at: int, end: bool = False) -> int:
    """Where a start (or an ``end``) in the repaired text lies in the text as given; a replaced span counts as a whole."""
    p = at - end
    for spans in reversed(passes):
        shift = 0  # by which the text before is longer up to here
        for s, e, n in spans:
            if p < s - shift:
                break
            if p < s - shift + n:
                p, shift = (e - 1 if end else s), 0
                break
            shift += e - s - n
        p += shift
    return p + end


_OUT = pa.schema([("rec_id", pa.int64()), ("damaged", pa.bool_()), ("repaired", pa.string()), ("spans", pa.int64()), ("encodings", pa.string()), ("lost", pa.int64())])


def repair_texts(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per text with characters outside ASCII: rec_id, damaged, repaired, spans, encodings, lost, and the columns of ``keep``.

    Null, empty and pure ASCII texts hold no damage and give no row; rows that repeat are judged each by itself;
    an empty table gives an empty result; all other columns are ignored whatever their names.
    """

    def make():
        def f(ids: list, texts: list) -> dict:
            rows = [repair(t) for t in texts]
            return {"rec_id": ids} | {n: [r[k] for r in rows] for k, n in enumerate(_OUT.names[1:])}

        return f

    some = df.filter(F.col(text_col).rlike(r"[^\x00-\x7F]"))
    return map_texts(some, id_col, text_col, _OUT, "rec_id long, damaged boolean, repaired string, spans long, encodings string, lost long", make, keep)


def map_values(df: DataFrame, id_col: str, map_col: str) -> DataFrame:
    """One row per value of a map column: (rec_id, key, value); null maps and null values give none."""
    return df.select(F.col(id_col).alias("_rec"), F.explode(F.col(map_col)).alias("_key", "_value")).filter("_value is not null")
