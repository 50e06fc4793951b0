"""Session helpers shared by the operators: shared checkpoint folder, lineage cuts, Arrow maps over texts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``; only where that is unset, and on one machine, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "textquarry-checkpoints"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """The columns of a scan, spread over the session's cores when a small file came as fewer splits.

    Scans of many splits (any input of real size) are left alone, so no data is shuffled there.
    """
    df = df.select(*cols) if cols else df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: pa.Schema, spark_schema: str, make: Callable[[], Callable[[list, list], dict]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Arrow-batched map over (id, text). ``make`` runs once per task and returns ``f(ids, texts) -> columns``.

    Only the two named columns travel to Python; others, whatever they are called, are ignored. Those of ``keep`` come
    out again as strings behind the rest, for an ``f`` that gives one row for each text, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                out = f(b.column(0).to_pylist(), b.column(1).to_pylist())
                made = pa.RecordBatch.from_pydict({n: out[n] for n in schema.names}, schema=schema)
                yield pa.RecordBatch.from_arrays([*made.columns, *b.columns[2:]], names=[*schema.names, *keep]) if keep else made

    kept = [F.col(c).cast("string").alias(f"_keep{i}") for i, c in enumerate(keep)]
    two = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *kept)
    return two.mapInArrow(run, ", ".join([spark_schema, *(f"`{c}` string" for c in keep)]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
