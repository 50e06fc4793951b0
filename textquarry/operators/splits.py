"""Exact splits, samples and orders that repeat: every draw is decided by a hash of seed and id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = {"train": 0.8, "validation": 0.1, "test": 0.1}


def check_ratios(ratios: Mapping[str, float]) -> None:
    if abs(sum(ratios.values()) - 1) > 0.01:
        raise ValueError(f"ratios sum to {sum(ratios.values())}, not 1")


def draw(seed: int, id_col: str) -> Column:
    """A hexadecimal draw, the same in every engine that has SHA-256."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)


def _ranked(df: DataFrame, keys: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """rank from 0 and size within each group; in two steps over 4,096 ranges of the draw, so no task orders a whole group."""
    keys = list(keys)
    base = df.withColumn("_d", draw(seed, id_col)).withColumn("_r", F.substring("_d", 1, 3))
    per = base.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per = per.withColumn("_before", F.sum("_n").over(over.orderBy("_r")) - F.col("_n")).withColumn("_size", F.sum("_n").over(over)).drop("_n")
    rn = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy("_d", id_col))
    ranked = base.withColumn("_rn", rn).join(per, [*keys, "_r"])
    return ranked.withColumn("_rank", F.col("_before") + F.col("_rn") - 1).drop("_d", "_r", "_rn", "_before")


def _assign(ratios: Mapping[str, float]) -> Column:
    """The split of a rank: floors of size times ratio, the rest to the last."""
    names = list(ratios)
    out, upto = F.lit(names[-1]), F.lit(0)
    bounds = []
    for name in names[:-1]:
        upto = upto + F.floor(F.col("_size") * F.lit(float(ratios[name])) + 1e-9)
        bounds.append((upto, name))
    for bound, name in reversed(bounds):
        out = F.when(F.col("_rank") < bound, F.lit(name)).otherwise(out)
    return out


def random_split(df: DataFrame, ratios: Mapping[str, float] = DEFAULT, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """The rows with a ``split`` of exact size."""
    check_ratios(ratios)
    return _ranked(df, (), id_col, seed).withColumn("split", _assign(ratios)).drop("_rank", "_size")


def stratified_split(df: DataFrame, field: str, ratios: Mapping[str, float] = DEFAULT, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """random_split within every value of a field; rows without one form a group of their own."""
    check_ratios(ratios)
    grouped = df.withColumn("_group", F.coalesce(F.col(field).cast("string"), F.lit("_missing_")))
    return _ranked(grouped, ("_group",), id_col, seed).withColumn("split", _assign(ratios)).drop("_rank", "_size", "_group")


def sample(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Exactly n rows (all, where there are fewer), without replacement; ranked in two steps, so that no task orders them all."""
    return _ranked(df, (), id_col, seed).filter(F.col("_rank") < n).drop("_rank", "_size")


def newest(df: DataFrame, keys: Sequence[str], by: str, n: int) -> DataFrame:
    """The n newest rows of each group; all groups together without keys."""
    if not keys:
        return df.orderBy(F.desc(by)).limit(n)
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).filter(F.col("_k") <= n).drop("_k")


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; fields that a part lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dataset_statistics(df: DataFrame, text_fields: Sequence[str] = ("text", "content", "body")) -> DataFrame:
    """(field, coverage, min, max, mean, total length of text fields); one aggregate."""
    kinds = dict(df.dtypes)
    texts = [f for f in text_fields if kinds.get(f) == "string"]
    one = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)), *(x for i, c in enumerate(df.columns) if c in texts for x in (F.min(F.length(c)).alias(f"a{i}"), F.max(F.length(c)).alias(f"b{i}"), F.avg(F.length(c)).alias(f"m{i}"), F.sum(F.length(c)).alias(f"s{i}"))))

    def of(letter: str, i: int, c: str, kind: str) -> Column:
        return (F.col(f"{letter}{i}") if c in texts else F.lit(None)).cast(kind)

    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.round(F.when(F.col("n") > 0, F.col(f"c{i}") / F.col("n")).otherwise(0.0), 6).alias("coverage"), of("a", i, c, "long").alias("min_length"), of("b", i, c, "long").alias("max_length"), F.round(of("m", i, c, "double"), 6).alias("avg_length"), of("s", i, c, "long").alias("total_length")) for i, c in enumerate(df.columns)))
    return one.select(F.inline(rows))


def metric_summary(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, mean, min, max) of metric columns, unpivoted after one aggregate."""
    one = metrics.agg(*(x for n in names for x in (F.avg(n).alias(f"{n}_avg"), F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"))))
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.round(F.col(f"{n}_avg"), 6).alias("mean"), F.round(F.col(f"{n}_min").cast("double"), 6).alias("min"), F.round(F.col(f"{n}_max").cast("double"), 6).alias("max")) for n in names))
    return one.select(F.inline(rows))
