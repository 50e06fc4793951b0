"""Datasets with splits: built from files, loaded again, and read as streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import splits
from textquarry.sources.storage import Storage

KINDS = ("json", "csv", "parquet")


def _reader(reader, kind: str, options: Mapping[str, object]):
    if kind not in KINDS:
        raise ValueError(f"unknown format: {kind}")
    own = {"header": True, "inferSchema": True, "multiLine": True, "escape": '"'} if kind == "csv" else {}
    return reader.format(kind).options(**own | dict(options))


def from_files(spark: SparkSession, paths: str | Sequence[str] | Mapping[str, str | Sequence[str]], kind: str, ratios: Mapping[str, float] | None = None, id_col: str | None = None, seed: int = 42, **options: object) -> DataFrame:
    """Rows of JSON lines, CSV or Parquet files with a ``split``.

    With a mapping the splits are its keys. Otherwise rows are drawn into ``ratios`` by ``id_col``, or by what they say
    where none is named, so equal rows lie together; without ratios all are "train".
    """
    if isinstance(paths, Mapping):
        parts = [_reader(spark.read, kind, options).load(p if isinstance(p, str) else list(p)).withColumn("split", F.lit(name)) for name, p in paths.items()]
        if not parts:
            raise ValueError("no files")
        return splits.union_all(*parts)
    df = _reader(spark.read, kind, options).load(paths if isinstance(paths, str) else list(paths))
    if not ratios:
        return df.withColumn("split", F.lit("train"))
    if id_col:
        return splits.random_split(df, ratios, id_col, seed)
    said = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    return splits.random_split(df.withColumn("_said", said), ratios, "_said", seed).drop("_said")


def kind_of(spark: SparkSession, path: str) -> str:
    """"parquet" or "json", by the files that are there."""
    for f in Storage(spark).files(path):
        if f.path.endswith(".parquet"):
            return "parquet"
        if ".json" in f.path.rsplit("/", 1)[-1] and not f.path.endswith("dataset_info.json"):
            return "json"
    raise FileNotFoundError(path)


def load(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset written by ``sinks.write_splits``; one split is read from its folder alone."""
    df = spark.read.format(kind_of(spark, path)).option("pathGlobFilter", "part-*").load(path)
    return df.filter(F.col("split") == split) if split else df


def stream(spark: SparkSession, path: str, split: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """The dataset as a stream, with the schema that it has now."""
    own = {"maxFilesPerTrigger": files_a_batch} if files_a_batch else {}
    df = spark.readStream.schema(load(spark, path).schema).options(pathGlobFilter="part-*", **own).format(kind_of(spark, path)).load(path)
    return df.filter(F.col("split") == split) if split else df
