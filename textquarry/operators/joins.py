"""Joins with a side that is unique by its key, safe where one key holds a large share of the other side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows; so there are fewer than its inverse of them.
HOT_SHARE = 1 / 64
#: Most bits of a sieve (16 MB). With more keys than that it lets more rows pass, and the join after it decides alone.
SIEVE_BITS = 1 << 27


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, unique by ``key``. Rows of the few hot keys meet a broadcast of at most as many rows as there are hot keys."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.filter(F.col(key).isin(hot)))
    return left.filter(~is_hot).join(right, key, how).unionByName(left.filter(is_hot).join(few, key, how))


def hot_counted(counts: DataFrame, key: str, count: str, total: int) -> list:
    """Keys that hold more than HOT_SHARE of ``total`` rows, where rows are already counted; fewer than 1/HOT_SHARE by construction."""
    return [r[0] for r in counts.filter(F.col(key).isNotNull() & (F.col(count) > max(1, int(total * HOT_SHARE)))).select(key).collect()]


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that hold more than HOT_SHARE of the rows."""
    return hot_counted(df.groupBy(key).agg(F.count("*").alias("_n")), key, "_n", df.count())


def sieved(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids``, its only column and without repeats; wide rows of most other keys are left out by a bitmap before they would be shuffled."""
    number = ids.count()
    bits = min(SIEVE_BITS, 1 << max(15, (16 * number).bit_length()))

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    of = place(F.col(ids.columns[0])) + 1  # places of bitmaps are counted from 1
    sets = ids.groupBy(F.bitmap_bucket_number(of).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of)).alias("bits")).collect()
    bitmap = np.zeros((bits >> 15, 1 << 12), dtype=np.uint8)
    for r in sets:
        bitmap[r["n"] - 1] = np.frombuffer(r["bits"], dtype=np.uint8)
    bitmap = df.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    @F.pandas_udf("boolean")
    def passes(places: pd.Series) -> pd.Series:
        p = places.to_numpy()
        return pd.Series((bitmap.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return df.filter(passes(place(F.col(key)))).join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
