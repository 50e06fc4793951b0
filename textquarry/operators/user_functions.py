"""User functions over documents: batches in Arrow, never rows one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str | None = None) -> DataFrame:
    """``f`` on every batch of rows; the schema is that of ``df`` unless one is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return df.mapInPandas(run, schema or df.schema)


def filter_by(df: DataFrame, f: Callable[[pd.Series], pd.Series], column: str = "text") -> DataFrame:
    """Rows for whose values ``f`` says true, batch by batch."""
    return df.filter(F.pandas_udf(f, BooleanType())(column))


class Registry:
    """Named functions from Column to Column, for configurations that name their own steps."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[Column], Column]] = {}

    def register(self, name: str, f: Callable[[Column], Column]) -> None:
        self._known[name] = f

    def apply(self, name: str, c: Column) -> Column:
        if name not in self._known:
            raise ValueError(f"unknown function: {name}")
        return self._known[name](c)

    def names(self) -> list[str]:
        return sorted(self._known)
