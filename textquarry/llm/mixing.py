"""Mixing sources to target shares of all tokens.

Method: documents are counted by source and exact token length. Each source gets a budget of tokens; whole rounds repeat
all its documents, what remains is filled first evenly over the lengths and then exactly, by a bounded-knapsack
dynamic program over the lengths left. Which documents of a length are taken, a seeded order decides.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.tokens import VOCABULARY, Vocabulary, count_udf, tidy
from textquarry.operators.ranking import seeded_rank
from textquarry.runtime import materialize

#: Sums, from one token up, that the dynamic program looks at in the last resort: where these do not hold the budget
#: either, and not all texts are among them, the mix may stay a few tokens below it.
MOST_SUMS = 1 << 24


def largest_sum(counts: list[tuple[int, int]], limit: int) -> tuple[int, dict[int, int]]:
    """(largest sum up to ``limit``, how many of each length make it up) of texts given as (length, count); exact.

    Bounded knapsack: the bits of an integer are the sums reached, counts are split into powers of two, and each sum
    remembers the part that reached it first, so that memory is a few bytes for each sum.
    """
    mask = (1 << (limit + 1)) - 1
    reached, parts = 1, []
    first = np.full(limit + 1, -1, dtype=np.int32)
    for n, c in counts:
        c = min(c, limit // n)
        part = 1
        while c > 0 and not (reached >> limit) & 1:
            k = min(part, c)
            new = (reached << (n * k)) & mask & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), dtype=np.uint8)
                at = np.flatnonzero(bits)
                on = np.flatnonzero(np.unpackbits(bits[at], bitorder="little"))
                first[at[on // 8] * 8 + on % 8] = len(parts)
                reached |= new
            parts.append((n, k))
            c -= k
            part *= 2
        if (reached >> limit) & 1:
            break
    best = at = reached.bit_length() - 1
    taken: dict[int, int] = {}
    while at:
        n, k = parts[first[at]]
        taken[n] = taken.get(n, 0) + k
        at -= n * k
    return best, taken


def fit(histogram: Mapping[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take, each at most once, for the largest sum up to ``budget``.

    Evenly over the lengths in order first, short of the budget by two of the longest; the rest exactly. Where no choice
    for that rest meets the budget, less is filled evenly, until it is met or all is left to the exact choice (MOST_SUMS).
    """
    total = sum(n * c for n, c in histogram.items())
    if budget >= total:
        return dict(histogram)
    if budget <= 0 or not histogram:
        return {}
    goal = budget - budget % math.gcd(*histogram)  # no sum lies between
    lengths = sorted(histogram, reverse=True)
    random.Random(budget).shuffle(lengths)
    window, best, found = 2 * max(histogram), -1, {}
    while True:
        part = max(0, goal - window)
        taken, seen, rest = {}, 0, goal
        for n in sorted(histogram):
            before, seen = seen, seen + histogram[n]
            taken[n] = seen * part // total - before * part // total
            rest -= n * taken[n]
        got, extra = largest_sum([(n, histogram[n] - taken[n]) for n in lengths], rest)
        if goal - rest + got > best:
            best, found = goal - rest + got, {n: k for n in taken if (k := taken[n] + extra.get(n, 0))}
        if best == goal or part == 0 or 4 * window > MOST_SUMS:
            return found
        window *= 4


def plan(histograms: Mapping[str, Mapping[int, int]], targets: Mapping[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, dict[int, int]]]:
    """source -> (whole rounds of all its documents, documents of each length to take once more).

    Shares are those of the sources that have documents, brought to a sum of 1. ``total`` is the size of the mix in
    tokens; by default the largest at which every source can keep its share within its repeats.
    """
    have = {s: sum(n * c for n, c in h.items()) for s, h in histograms.items() if s in targets}
    have = {s: n for s, n in have.items() if n > 0 and targets[s][0] > 0 and targets[s][1] > 0}
    whole = sum(targets[s][0] for s in have)
    if not have:
        return {}
    most = min(n * targets[s][1] * whole / targets[s][0] for s, n in have.items())
    size = most if total is None else total
    out = {}
    for s, n in have.items():
        wanted = min(int(size * targets[s][0] / whole + 1e-6), n * targets[s][1])
        rounds = wanted // n
        out[s] = (rounds, fit(histograms[s], wanted - rounds * n) if wanted > rounds * n else {})
    return out


def mix(df: DataFrame, targets: DataFrame, seed: int = 42, total: int | None = None, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens, copies: how often each document of the mix is taken; documents not taken give no row.

    Sources of both tables are compared without letter case and outer blanks; documents without source, text or tokens
    never enter; a source named twice in ``targets`` has its shares added and its smallest max_repeats; a named source
    without documents gets nothing. Empty tables give an empty mix.
    """
    spark = df.sparkSession
    wanted = targets.filter("source is not null").groupBy(tidy(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most"))
    goals = {r.source: (r.share or 0.0, r.most or 0) for r in wanted.collect()}  # the targets are written by hand
    counted = materialize(_counted(df, list(goals), path))
    lengths = counted.groupBy("source", "tokens").agg(F.count("*").alias("n")).collect()  # at most sqrt(2 x tokens of a source) rows for each
    histograms: dict[str, dict[int, int]] = {}
    for r in lengths:
        histograms.setdefault(r.source, {})[r.tokens] = r.n
    rows = [(s, n, rounds, extra.get(n, 0)) for s, (rounds, extra) in plan(histograms, goals, total).items() for n in histograms[s]]
    chosen = spark.createDataFrame(rows, "source string, tokens long, rounds long, extra long")
    ranked = seeded_rank(counted, ["source", "tokens"], "doc_id", seed).join(chosen, ["source", "tokens"])
    copies = F.col("rounds") + F.when(F.col("_rank") <= F.col("extra"), 1).otherwise(0)
    return ranked.select("doc_id", "source", "tokens", copies.alias("copies")).filter("copies > 0")


def _counted(df: DataFrame, sources: list[str], path: str) -> DataFrame:
    """doc_id, source, tokens of the documents of these sources; the text is counted beside its source, without a join."""
    count = count_udf(df.sparkSession.sparkContext.broadcast(Vocabulary.load(path)))
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), tidy(F.col("source")).alias("source"), F.col("text").alias("_text")).filter(F.col("source").isin(sources))
    return own.select("doc_id", "source", count("_text").alias("tokens")).filter("tokens > 0")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For every target: source, target_share, max_repeats, docs, tokens taken, most copies of a document, share reached."""
    by = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    by = by.withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # a row for each named source
    goals = targets.select(tidy(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = goals.join(by, "source", "left")
    share = F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6)
    return out.select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("docs", "tokens", "most_copies")), share.alias("share"))
