"""Groups of records tied by shared keys, and splits that keep groups together.

Groups come from a distributed union-find: each task builds the forest of its own block of links, forests are merged
block by block over a tree, and once a merged block would outgrow one task the rest is contracted by alternating star
steps over all tasks. Splits come from greedy largest-first assignment of groups to the split furthest below target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.joins import HOT_SHARE, hot_counted, join_unique
from textquarry.operators.ranking import seeded_rank
from textquarry.runtime import materialize

#: Links that one task may hold when forests are merged.
BLOCK_LINKS = 2_000_000
#: Forests merged into one at each level of the tree.
FAN_IN = 8


def local_forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one block: (node, smallest node it reaches) for every node but the roots."""
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    parent = list(range(len(nodes)))  # by position, so that the smallest root is the smallest node
    half = len(src)
    for a, b in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    root = np.array(parent, dtype=np.int64)
    while len(root) and (up := root[root]).tobytes() != root.tobytes():
        root = up
    child = root != np.arange(len(root))
    return nodes[child], nodes[root[child]]


def _forests(links: DataFrame, fan_in: int) -> DataFrame:
    """Each partition's forest, with the number of the block that it is merged into next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            v, r = local_forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            block = TaskContext.get().partitionId() // fan_in
            yield pa.RecordBatch.from_pydict({"src": v, "dst": r, "block": np.full(len(v), block, dtype=np.int64)})

    return links.select("src", "dst").mapInArrow(run, "src long, dst long, block long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: every node passes its smallest neighbour on, to larger neighbours (large) or smaller ones (small)."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else links
    least = materialize(both.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "src")))
    hot = hot_counted(least, "src", "n", least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    seen = join_unique(both, least.drop("n"), "src", hot, "inner")
    if large:
        out = seen.filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = seen.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))
    return out.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def components(links: DataFrame, block_links: int = BLOCK_LINKS) -> DataFrame:
    """(node, root) of all nodes of ``links`` (src, dst: long); root is the smallest node that ties lead to.

    Links with a null end and links of a node to itself tie nothing and are ignored; an empty table gives none.
    """
    links = links.select("src", "dst").filter("src is not null and dst is not null and src <> dst")
    forest = materialize(_forests(links, FAN_IN))
    while True:
        count, blocks = forest.agg(F.count("*"), F.count_distinct("block")).first()
        if blocks <= 1 and count <= block_links:
            # one block came from at most FAN_IN partitions: a last merge makes it one forest
            forest = materialize(_forests(forest.coalesce(1), 1))
            break
        if count > block_links * max(1, blocks) / FAN_IN and count > block_links:
            forest = _contract(forest)
            break
        forest = materialize(_forests(forest.repartition(blocks, "block"), FAN_IN))
    pairs = forest.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())


def _contract(forest: DataFrame) -> DataFrame:
    """Alternating star steps until nothing changes; every step is an aggregate and a join over all tasks."""
    links = forest.select("src", "dst").distinct()
    state = None
    while True:
        links = materialize(_star(_star(links, True).select("src", "dst"), False))
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())
        if now == state:
            return links
        state = now


def tied_groups(df: DataFrame, id_col: str, keys: Sequence[Column], block_links: int = BLOCK_LINKS) -> DataFrame:
    """(rec_id, group_id, group_size) with each id once; ids are tied by equal non-null keys, directly or through others.

    group_id is the smallest id of the group. Null ids give no row, repeated rows count once, an id that comes with
    several keys ties them all, and columns of any other name are ignored.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    base = df.select(F.col(id_col).cast("long").alias("_id"), *(k.alias(n) for k, n in zip(keys, named, strict=True))).filter("_id is not null").distinct()
    base = materialize(base)
    total = base.count()
    linked, hot_reps = base, set()
    for n in named:
        counts = materialize(base.filter(F.col(n).isNotNull()).groupBy(n).agg(F.min("_id").alias("_r" + n), F.max("_id").alias("_last"), F.count("*").alias("_n")).filter(F.col("_r" + n) < F.col("_last")))
        hot = counts.filter(F.col("_n") > max(1, int(total * HOT_SHARE))).select(n, "_r" + n).collect()  # fewer than 1/HOT_SHARE
        hot_reps.update(r[1] for r in hot)
        linked = join_unique(linked, counts.select(n, "_r" + n), n, [r[0] for r in hot])  # a key of one record ties nothing
    reps = ["_r" + n for n in named]
    linked = materialize(linked.select("_id", *reps))
    member = linked.select("_id", F.coalesce(*reps).alias("rep")).distinct()
    across = [linked.select(F.coalesce(*reps).alias("src"), F.col(r).alias("dst")) for r in reps[1:]]
    several = member.filter("rep is not null").withColumn("first", F.min("rep").over(Window.partitionBy("_id")))
    links = several.select(F.col("rep").alias("src"), F.col("first").alias("dst"))
    for a in across:
        links = links.unionByName(a)
    roots = components(links.filter("src <> dst").distinct(), block_links).select(F.col("node").alias("rep"), "root")
    member = join_unique(member, roots, "rep", sorted(hot_reps)).select("_id", F.coalesce("root", "rep", "_id").alias("group_id"))  # only reps of hot keys can be hot
    member = materialize(member.groupBy("_id").agg(F.min("group_id").alias("group_id")))
    sizes = materialize(member.groupBy("group_id").agg(F.count("*").alias("group_size")))
    return join_unique(member, sizes, "group_id", hot_counted(sizes, "group_id", "group_size", total)).select(F.col("_id").alias("rec_id"), "group_id", "group_size")


def greedy_allocation(histogram: list[tuple[int, int]], shares: Sequence[float]) -> dict[int, list[int]]:
    """For each group size, how many of its groups go to each split.

    histogram: (size, number of groups). Largest first, each group to the split furthest below its target; ties go to
    the split named first. Long runs of equal groups are dealt in whole rounds, which is where one by one leads as well.
    """
    total = sum(s * c for s, c in histogram)
    missing = [total * x / sum(shares) for x in shares]
    out: dict[int, list[int]] = {}
    for size, count in sorted(histogram, reverse=True):
        got = [0] * len(shares)
        while count:
            order = sorted(range(len(missing)), key=lambda i: (-missing[i], i))
            first, second = order[0], order[1] if len(order) > 1 else order[0]
            ahead = int((missing[first] - missing[second]) // size)
            if ahead > 1 or len(order) == 1:  # only the first is served until it is level with the second
                n = min(count, max(1, ahead) if len(order) > 1 else count)
                got[first] += n
                missing[first] -= n * size
                count -= n
            elif count > 1000 * len(order) and missing[order[0]] - missing[order[-1]] <= size:
                n = count // len(order) - 1  # all are level: whole rounds
                for i in order:
                    got[i] += n
                    missing[i] -= n * size
                count -= n * len(order)
            else:
                got[first] += 1
                missing[first] -= size
                count -= 1
        out[size] = got
    return out


def group_splits(groups: DataFrame, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """(rec_id, group_id, split): ``groups`` of tied_groups dealt to splits near their shares, no group divided.

    Of groups of one size, the seeded order of their ids decides. Sizes differ at most sqrt(2 x records) ways, which
    bounds what the driver sees. An empty table gives none.
    """
    spark = groups.sparkSession
    names = list(shares)
    each = materialize(groups.select("group_id", "group_size").distinct())
    histogram = [(r.group_size, r.n) for r in each.groupBy("group_size").agg(F.count("*").alias("n")).collect()]
    rows = [(size, *np.cumsum(got).tolist()) for size, got in greedy_allocation(histogram, list(shares.values())).items()]
    until = spark.createDataFrame(rows, "group_size long, " + ", ".join(f"_u{i} long" for i in range(len(names))))
    ranked = seeded_rank(each, ["group_size"], "group_id", seed).join(F.broadcast(until), "group_size")
    split = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        split = F.when(F.col("_rank") <= F.col(f"_u{i}"), F.lit(names[i])).otherwise(split)
    chosen = ranked.select("group_id", split.alias("split"))
    hot = hot_counted(each, "group_id", "group_size", sum(s * n for s, n in histogram))
    return join_unique(groups.select("rec_id", "group_id"), chosen, "group_id", hot).select("rec_id", "group_id", "split")
