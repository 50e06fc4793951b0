"""Rule-based augmentation: documents in, more documents out; every draw is a hash of seed, document and rule.

Phrase rules are Column expressions; rules that draw among words or change whole sentences are Arrow functions seeded
per row.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textquarry.operators.splits import sample

# Tables of our own: words and phrases with others of like meaning.
SYNONYMS = {
    "important": ("significant", "essential"), "good": ("fine", "sound"), "bad": ("poor", "weak"), "big": ("large", "sizeable"), "small": ("little", "modest"),
    "quick": ("fast", "swift"), "help": ("assist", "aid"), "show": ("reveal", "display"), "use": ("employ", "apply"), "make": ("create", "produce"),
    "think": ("believe", "hold"), "many": ("numerous", "several"), "new": ("recent", "fresh"), "old": ("aged", "former"), "begin": ("start", "open"),
    "end": ("finish", "close"), "counted": ("tallied", "numbered"), "measured": ("gauged", "assessed"), "described": ("outlined", "portrayed"), "reported": ("stated", "noted"),
}
PHRASES = (
    ("in order to", "to"), ("due to the fact that", "because"), ("because of", "owing to"), ("as well as", "and also"), ("at the end of", "at the close of"),
    ("a number of", "several"), ("in the event that", "if"), ("with great care", "very carefully"), ("for the next edition", "for the edition to come"), ("at this point in time", "now"),
)
CONJUNCTIONS = ("and", "but", "or", "because", "although", "while", "when")
PARTICIPLES = {"written": "wrote", "taken": "took", "given": "gave", "made": "made", "done": "did", "seen": "saw", "found": "found", "built": "built", "chosen": "chose", "broken": "broke", "sold": "sold", "read": "read"}


def chance(id_col: str, rule: str, seed: int, k: Column | int = 0) -> Column:
    """A draw from 0 to 1."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(rule), F.lit(k) if isinstance(k, int) else k, F.lit(seed)), F.lit(1_000_000)) / 1_000_000


_SPLIT = re.compile(r"^(.*?)(\W*)$", re.S)


def with_synonyms(text: str, rate: float, seed: int) -> str:
    """About ``rate`` of the words that have synonyms, at least one; capitals and closing signs stay with the word."""
    words = text.split(" ")
    parts = [_SPLIT.match(w).groups() for w in words]
    places = [i for i, (bare, _) in enumerate(parts) if bare.lower() in SYNONYMS]
    rng = random.Random(seed)
    rng.shuffle(places)
    for i in places[: max(1, int(len(words) * rate))]:
        bare, signs = parts[i]
        new = rng.choice(SYNONYMS[bare.lower()])
        words[i] = (new[:1].upper() + new[1:] if bare[:1].isupper() else new) + signs
    return " ".join(words)


def replace_synonyms(text: Column, id_col: str, rate: float = 0.1, seed: int = 42) -> Column:
    """``with_synonyms`` for every row, drawn by seed and id; null stays null."""

    @F.pandas_udf(StringType())
    def replaced(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else with_synonyms(t, rate, int(s)) for t, s in zip(texts, seeds, strict=True)], dtype=object)

    return replaced(text, F.xxhash64(F.col(id_col), F.lit("synonym"), F.lit(seed)))


def transform_phrases(text: Column) -> Column:
    """All phrases of the table, in whatever case."""
    for old, new in PHRASES:
        text = F.regexp_replace(text, rf"(?i)\b{old}\b", new)
    return text


def restructure(sentence: str) -> str:
    """A passive with a known participle made active; else the clauses around the first conjunction swapped."""
    m = re.fullmatch(r"(?P<object>[^,;]+?) (?:was|were) (?P<verb>\w+) by (?P<subject>[^,;]+)", sentence, re.I)
    if m and m["verb"].lower() in PARTICIPLES:
        subject, thing = m["subject"], m["object"]
        return f"{subject[:1].upper()}{subject[1:]} {PARTICIPLES[m['verb'].lower()]} {thing[:1].lower()}{thing[1:]}"
    for m in re.finditer(r" (\w+)(?= )", sentence):
        if m.group(1).lower() in CONJUNCTIONS:
            first, second = sentence[: m.start()].strip(" ,"), sentence[m.end() :].strip(" ,")
            if first and second:
                return f"{second[:1].upper()}{second[1:]} {m.group(1)} {first[:1].lower()}{first[1:]}"
            break
    return sentence


@F.pandas_udf(StringType())
def restructured(texts: pd.Series) -> pd.Series:
    """Every sentence restructured; sentences are joined by ". "."""

    def one(t: str) -> str:
        pieces = [p.strip() for p in re.split(r"(?<=[.!?])\s+", t) if p.strip()]
        return ". ".join(restructure(p.rstrip(".")) if p.endswith(".") else p for p in pieces) + ("." if t.rstrip().endswith(".") else "")

    return texts.map(one, na_action="ignore")


def paraphrases(df: DataFrame, copies: int = 2, intensity: float = 0.7, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents and up to ``copies`` paraphrases of each: is_paraphrase, original_id.

    A paraphrase takes synonyms, phrases and structure each with the chance ``intensity``; repeats and texts that came
    out unchanged are dropped. Documents without text are kept without paraphrases.
    """
    out = df.withColumn("is_paraphrase", F.lit(False)).withColumn("original_id", F.lit(None).cast(df.schema[id_col].dataType))
    t = F.col(text_col)
    for k in range(copies):
        new = df.filter(t.isNotNull())
        new = new.withColumn("_t", F.when(chance(id_col, "synonym", seed, k) < intensity, replace_synonyms(t, id_col, 0.1, seed + k)).otherwise(t))
        new = new.withColumn("_t", F.when(chance(id_col, "phrase", seed, k) < intensity, transform_phrases(F.col("_t"))).otherwise(F.col("_t")))
        new = new.withColumn("_t", F.when(chance(id_col, "structure", seed, k) < intensity, restructured("_t")).otherwise(F.col("_t")))
        new = new.filter(F.col("_t") != t).withColumn(text_col, F.col("_t")).drop("_t")
        out = out.unionByName(new.withColumn("is_paraphrase", F.lit(True)).withColumn("original_id", F.col(id_col)))
    return out.dropDuplicates([id_col, text_col, "is_paraphrase"])


QUESTIONS = (
    (re.compile(r"(?i)^what (?:is|are) (.+?)\?*$"), ("Could you explain {0}?", "How would you define {0}?", "Tell me about {0}.", "What does {0} mean?")),
    (re.compile(r"(?i)^how do (?:you|i|we) (.+?)\?*$"), ("What is the way to {0}?", "Which steps does it take to {0}?", "How can one {0}?", "Describe how to {0}.")),
    (re.compile(r"(?i)^why (.+?)\?*$"), ("For what reason {0}?", "What explains why {0}?", "Say why {0}.", "What is the cause that {0}?")),
)
INSTRUCTIONS = (
    (re.compile(r"(?i)^please (.+?)[.!]*$"), ("Could you {0}?", "Kindly {0}.", "I would like you to {0}.", "Would you {0}?")),
    (re.compile(r"(?i)^(create|write) (.+?)[.!]*$"), ("Please {0} {1}.", "Your task is to {0} {1}.", "I need you to {0} {1}.", "Can you {0} {1}?")),
)


def template_paraphrase(text: str, k: int, tables=QUESTIONS + INSTRUCTIONS) -> str | None:
    """A question or instruction in the k-th other form; None where no form fits."""
    for pattern, forms in tables:
        if m := pattern.match(text.strip()):
            parts = [p[:1].lower() + p[1:] for p in m.groups()]
            return forms[k % len(forms)].format(*parts)
    return None


# Tables of our own for the round trip through another language.
FORMAL = (("don't", "do not"), ("can't", "cannot"), ("it's", "it is"), ("isn't", "is not"), ("won't", "will not"))
PREPOSITIONS = (("in", "within"), ("on", "upon"), ("for", "on behalf of"), ("about", "concerning"))
LEXICAL = {"get": "obtain", "got": "obtained", "buy": "purchase", "bought": "purchased", "need": "require", "ask": "inquire", "keep": "retain", "kept": "retained", "start": "commence", "stop": "cease"}
EFFECTS = {
    "es": ((r"\b(\w+) (?:house|page|book)\b", r"the \g<0> of it"), (r"\bvery (\w+)\b", r"quite \1")),
    "fr": ((r"\b(\w+)ly\b", r"in a \1 way"), (r"\ba lot of\b", "much of")),
    "de": ((r"\b(because) ([^.,;]+)", r"\1 that \2"), (r"\bwent\b", "is gone")),
    "it": ((r"\b(my|your|our) (\w+)\b", r"the \1 \2"), (r"\b(\w+) too\b", r"also \1")),
    "pt": ((r"\b(\w+) years old\b", r"with \1 years"), (r"\bhow are you\b", "all is well")),
}


def back_translate(text: str, seed: int, language: str = "es", advanced: bool = False, rate: float = 0.3) -> str:
    """Traces of a round trip: formality, prepositions, articles, the language's own habits; edits run from right to left."""
    rng = random.Random(seed)
    for old, new in FORMAL:
        text = re.sub(rf"(?i)\b{re.escape(old)}\b", new, text)
    for old, new in PREPOSITIONS:
        for m in reversed(list(re.finditer(rf"\b{old}\b", text))):
            if rng.random() < rate / 3:
                text = text[: m.start()] + new + text[m.end() :]
    for m in reversed(list(re.finditer(r"\b(?:a|the) (?=\w)", text))):
        if rng.random() < rate / 5:
            text = text[: m.start()] + ("the " if m.group() == "a " else "a ") + text[m.end() :]
    for pattern, new in EFFECTS.get(language, EFFECTS["es"]):
        if rng.random() < rate:
            text = re.sub(pattern, new, text, count=1)
    if advanced:
        text = re.sub(r"\b\w+\b", lambda m: LEXICAL.get(m.group(), m.group()) if rng.random() < 0.8 else m.group(), text)
        text = re.sub(r"\bis (\w+)ing\b", r"\1s", text) if rng.random() < rate else text
        pieces = [restructure(p) if rng.random() < rate / 2 else p for p in re.split(r"(?<=[.!?])\s+", text)]
        text = " ".join(pieces)
    return re.sub(r"\s+", " ", text).strip()


def back_translations(df: DataFrame, ratio: float = 0.5, variations: int = 2, languages: Sequence[str] = ("es", "fr", "de", "it", "pt"), advanced: bool = False, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents and ``variations`` round trips of exactly floor(rows x ratio) of them: is_back_translation, original_id, variation_index."""
    total = df.count()
    chosen = sample(df.filter(F.col(text_col).isNotNull()), int(total * ratio), id_col, seed)

    @F.pandas_udf(StringType())
    def trip(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([back_translate(t, int(s), languages[int(s) % len(languages)], advanced) for t, s in zip(texts, seeds, strict=True)], dtype=object)

    copies = chosen.withColumn("variation_index", F.explode(F.sequence(F.lit(0), F.lit(variations - 1)))) if variations > 0 else chosen.withColumn("variation_index", F.lit(0)).limit(0)
    copies = copies.withColumn(text_col, trip(F.col(text_col), F.pmod(F.xxhash64(F.col(id_col), F.col("variation_index"), F.lit(seed)), F.lit(2**31))))
    own = df.schema[id_col].dataType
    originals = df.withColumn("is_back_translation", F.lit(False)).withColumn("original_id", F.lit(None).cast(own)).withColumn("variation_index", F.lit(None).cast("int"))
    return originals.unionByName(copies.withColumn("is_back_translation", F.lit(True)).withColumn("original_id", F.col(id_col)))


def statistics(df: DataFrame, flag: str) -> DataFrame:
    """original, augmented, total and the ratio of augmented to original."""
    return df.agg(F.count_if(~F.col(flag)).alias("original"), F.count_if(flag).alias("augmented"), F.count("*").alias("total")).withColumn("ratio", F.when(F.col("original") > 0, F.round(F.col("augmented") / F.col("original"), 6)).otherwise(0.0))


@F.pandas_udf(StringType())
def _composite(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    def one(t: str, seed: int) -> str:
        return template_paraphrase(t, seed) or back_translate(t, seed)

    return pd.Series([None if t is None else one(t, int(s)) for t, s in zip(texts, seeds, strict=True)], dtype=object)


def composite_paraphrase(text: Column, id_col: str, seed: int = 42) -> Column:
    """A template's other form where one fits; else synonyms and phrases, then traces of a round trip."""
    ruled = transform_phrases(replace_synonyms(text, id_col, 0.1, seed))
    fits = text.rlike(r"(?i)^\s*(?:what (?:is|are)|how do (?:you|i|we)|why|please|create|write)\b")
    return _composite(F.when(fits, text).otherwise(ruled), F.pmod(F.xxhash64(F.col(id_col), F.lit("composite"), F.lit(seed)), F.lit(2**31)))
