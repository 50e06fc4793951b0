"""Seeded ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seeded_rank(df: DataFrame, keys: Sequence[str], id_col: str, seed: int, name: str = "_rank") -> DataFrame:
    """``df`` with a rank from 1 within each group of ``keys``, in the order of a seeded hash of ``id_col``.

    The order is found in two steps, over 4,096 ranges of the hash and within each, so no task sorts a whole large group.
    Null keys form a group of their own; equal ids are ranked one after the other.
    """
    keys = list(keys)
    df = df.withColumn("_h", F.xxhash64(F.lit(seed), id_col)).withColumn("_b", F.shiftrightunsigned("_h", 52).cast("int"))
    per = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    per = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", id_col))
    left, right = df.withColumn("_rn", within).alias("l"), per.alias("r")
    on = F.col("l._b") == F.col("r._b")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, on).select("l.*", F.col("r._before")).withColumn(name, F.col("_before") + F.col("_rn")).drop("_h", "_b", "_rn", "_before")
