"""Seeded synthetic texts, instruction pairs and conversations from templates; rows come from a range, never from a list."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.splits import union_all

# Tables of our own.
VOCABULARY = {
    "topic": ("soil health", "river ferries", "night trains", "paper making", "bird migration", "bread baking"),
    "quality": ("reliable", "simple", "careful", "surprising", "affordable"),
    "place": ("the old harbour", "a mountain village", "the city library", "a small workshop"),
    "person": ("a teacher", "the engineer", "our neighbour", "a young baker"),
    "action": ("compared", "measured", "described", "repaired", "collected"),
    "number": ("three", "seven", "twelve", "forty"),
}
TEMPLATES = {
    "news": ("In {place}, {person} {action} {number} reports on {topic}.", "Officials said that work on {topic} in {place} would take {number} weeks."),
    "tutorial": ("To learn about {topic}, begin with {number} {quality} steps.", "First, {person} {action} the tools; then the work on {topic} can start."),
    "review": ("After {number} days, {person} found the guide to {topic} {quality}.", "A {quality} book about {topic}, read in {place}."),
    "dialogue": ("{person} asked about {topic}. The answer was {quality}.", "In {place} they talked about {topic} for {number} hours."),
    "description": ("{topic} is {quality} when {person} works in {place}.", "The notes on {topic} filled {number} pages."),
}
PAIRS = {
    "explanation": ("Explain {topic} in {number} sentences.", "{topic} can be explained in a {quality} way: {person} {action} it in {place}."),
    "summary": ("Summarise what is known about {topic}.", "In short, {topic} is {quality}."),
    "comparison": ("Compare {topic} with the work in {place}.", "Both are {quality}, but {person} {action} only one of them."),
    "list": ("List {number} facts about {topic}.", "Here are {number} {quality} facts about {topic}."),
    "advice": ("Give {person} advice on {topic}.", "Be {quality}, and visit {place} first."),
}
FLOWS = {
    "help": (("user", "Can you help me with {topic}?"), ("assistant", "Of course. What have you {action} so far?"), ("user", "I {action} {number} samples."), ("assistant", "Then try a {quality} method."), ("user", "Where can I read more?"), ("assistant", "In {place}.")),
    "interview": (("host", "How did you come to {topic}?"), ("guest", "I met {person} in {place}."), ("host", "Was it {quality}?"), ("guest", "For {number} years, yes."), ("host", "What did you learn?"), ("guest", "That it should be {action} slowly.")),
    "planning": (("lead", "We have {number} days for {topic}."), ("member", "I can work in {place}."), ("lead", "Who {action} the first part?"), ("member", "That was {person}."), ("lead", "Was it {quality}?"), ("member", "Quite.")),
}


def _pick(options: Sequence, seed: int, *salt: Column) -> Column:
    h = F.pmod(F.xxhash64(F.col("id"), *salt, F.lit(seed)), F.lit(len(options))) + 1
    return F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), h.cast("int"))


def _values(seed: int) -> Column:
    return F.create_map(*(x for name, words in VOCABULARY.items() for x in (F.lit(name), _pick(words, seed, F.lit(name)))))


def _filled(template: Column, values: Column) -> Column:
    """Placeholders replaced; one without a value becomes its name in brackets."""
    for name in VOCABULARY:
        template = F.replace(template, F.lit(f"{{{name}}}"), values[name])
    template = F.regexp_replace(template, r"\{(\w+)\}", r"[$1]")
    return F.concat(F.upper(F.substring(template, 1, 1)), F.substring(template, 2, 100000))


def texts(spark: SparkSession, n: int, kinds: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """id, text, template_type, generated."""
    kinds = tuple(kinds or TEMPLATES)
    base = spark.range(n).withColumn("template_type", _pick(kinds, seed, F.lit("kind"))).withColumn("v", _values(seed))
    template = F.lit(None).cast("string")
    for k in kinds:
        template = F.when(F.col("template_type") == k, _pick(TEMPLATES[k], seed, F.lit("form"))).otherwise(template)
    return base.select("id", _filled(template, F.col("v")).alias("text"), "template_type", F.lit(True).alias("generated"))


def instructions(spark: SparkSession, n: int, kinds: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """id, instruction, response, type, variables: those that the pair uses."""
    kinds = tuple(kinds or PAIRS)
    base = spark.range(n).withColumn("type", _pick(kinds, seed, F.lit("kind"))).withColumn("v", _values(seed))
    ask = answer = F.lit(None).cast("string")
    used = F.array().cast("array<string>")
    for k in kinds:
        here = F.col("type") == k
        ask, answer = F.when(here, F.lit(PAIRS[k][0])).otherwise(ask), F.when(here, F.lit(PAIRS[k][1])).otherwise(answer)
        names = sorted(set(re.findall(r"\{(\w+)\}", " ".join(PAIRS[k]))))
        used = F.when(here, F.array(*map(F.lit, names))).otherwise(used)
    base = base.withColumn("u", used)
    return base.select("id", _filled(ask, F.col("v")).alias("instruction"), _filled(answer, F.col("v")).alias("response"), "type", F.map_filter("v", lambda k, _: F.array_contains("u", k)).alias("variables"))


def conversations(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id, conversation: array of speaker, message, turn_number."""
    names = tuple(FLOWS)
    base = spark.range(n).withColumn("flow", _pick(names, seed, F.lit("flow"))).withColumn("v", _values(seed))
    out = None
    for name in names:
        turns = F.array(*(F.struct(F.lit(s).alias("speaker"), _filled(F.lit(m), F.col("v")).alias("message"), F.lit(i + 1).alias("turn_number")) for i, (s, m) in enumerate(FLOWS[name])))
        out = F.when(F.col("flow") == name, turns) if out is None else out.when(F.col("flow") == name, turns)
    return base.select("id", out.alias("conversation"), F.lit("conversation").alias("content_type"))


def mixed(spark: SparkSession, n: int = 1000, shares: Mapping[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Texts, instruction pairs and conversations in floors of their shares, in a seeded order; shares are brought to 1."""
    shares = dict(shares or {"text": 0.4, "instruction": 0.4, "conversation": 0.2})
    total = sum(shares.values())
    if abs(total - 1) > 0.01:
        shares = {k: v / total for k, v in shares.items()}
    makers = {"text": texts, "instruction": instructions, "conversation": conversations}
    parts = [makers[k](spark, int(n * v + 1e-9), seed=seed).withColumn("content_type", F.lit(k)) for k, v in shares.items()]
    return union_all(*parts).orderBy(F.xxhash64("content_type", "id", F.lit(seed)))


def as_documents(df: DataFrame) -> DataFrame:
    """``text`` of instruction pairs is the instruction and the response."""
    pair = F.concat(F.lit("Instruction: "), F.col("instruction"), F.lit("\nResponse: "), F.col("response"))
    return df.withColumn("text", F.coalesce(F.col("text"), pair) if "text" in df.columns else pair)


def statistics(df: DataFrame) -> DataFrame:
    """(kind, count) of generated rows."""
    kind = F.coalesce(*(F.col(c) for c in ("content_type", "template_type") if c in df.columns), F.lit("unknown"))
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("count"))
