import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textquarry.llm import grouping as G


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("block", [1, 40, 10_000])
def test_components_whatever_the_block(spark, block):
    rng = random.Random(block)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(120)]
    df = spark.createDataFrame([*pairs, (None, 1), (5, 5)], "src long, dst long").repartition(7)
    got = {r.node: r.root for r in G.components(df, block).collect()}
    want = brute([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert G.components(df.limit(0), block).count() == 0


def test_long_chain(spark):
    df = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).repartition(5)
    assert {r.root for r in G.components(df, 10).collect()} == {0}


def test_tied_groups(spark):
    rows = [(1, "ann", "p1"), (2, "bob", "p1"), (3, "bob", None), (4, None, None), (5, "eve", "p2"), (5, "eve", "p2"), (6, "dan", "p3"), (6, "eve", "p3"), (None, "ann", "p1")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id long, a string, b string, group_id int, rep string")  # clashing names
    got = {r.rec_id: (r.group_id, r.group_size) for r in G.tied_groups(df, "id", [F.col("a"), F.col("b")]).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 2), 6: (5, 2)}
    assert G.tied_groups(df.limit(0), "id", [F.col("a"), F.col("b")]).count() == 0


def test_hot_key(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("a"), (F.col("id") % 900).cast("string").alias("b"))
    got = G.tied_groups(df, "id", [F.col("a"), F.col("b")]).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.group_id].add(r.rec_id)
    want = brute([(("r", i), k) for i in range(3000) for k in ((("a", "hot") if i % 3 == 0 else ("a", str(i))), ("b", str(i % 900)))] and [(i, j) for i in range(3000) for j in ([0] if i % 3 == 0 else []) + [i % 900]])
    assert {r.rec_id: r.group_id for r in got} == {i: want.get(i, i) for i in range(3000)}


def test_splits_keep_groups(spark):
    df = spark.range(1000).select(F.col("id").alias("rec_id"), F.floor(F.sqrt("id")).cast("long").alias("group_id"))
    sizes = df.groupBy("group_id").agg(F.count("*").alias("group_size"))
    out = G.group_splits(df.join(sizes, "group_id"), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(out) == 1000
    split_of = defaultdict(set)
    for r in out:
        split_of[r.group_id].add(r.split)
    assert all(len(s) == 1 for s in split_of.values())
    share = sum(r.split == "train" for r in out) / 1000
    assert abs(share - 0.8) < 0.05
    assert G.group_splits(df.join(sizes, "group_id").limit(0), {"a": 1.0}).count() == 0


def test_greedy_in_bulk_is_near_targets():
    got = G.greedy_allocation([(1, 100_000), (500, 3), (40_000, 1)], [0.8, 0.1, 0.1])
    total = 100_000 + 1500 + 40_000
    for i, share in enumerate((0.8, 0.1, 0.1)):
        assert abs(sum(s * k[i] for s, k in got.items()) - share * total) <= 500
    assert sum(got[1]) == 100_000
