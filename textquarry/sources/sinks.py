"""Writers of documents: JSON lines and Parquet, mapped, sharded, partitioned; and checks of written files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructType

from textquarry.sources.storage import Storage, join

CODECS = {"jsonl": ("none", "gzip"), "parquet": ("none", "snappy", "gzip", "lz4", "zstd", "brotli", "lzo")}


def _codec(kind: str, compression: str | None) -> str:
    name = compression or "none"
    if name not in CODECS[kind]:
        raise ValueError(f"unsupported compression for {kind}: {name}")
    return name


def field(df: DataFrame, path: str) -> Column:
    """A field by its own name, else by a path with dots through structs and maps; null where there is none."""
    if path in df.columns:
        return F.col(f"`{path}`")
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None).cast("string")
    c, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for name in rest:
        if isinstance(kind, StructType) and name in kind.fieldNames():
            c, kind = c.getField(name), kind[name].dataType
        elif isinstance(kind, MapType):
            c, kind = F.try_element_at(c, F.lit(name)), kind.valueType
        else:
            return F.lit(None).cast("string")
    return c


def mapped(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """Columns {out: path}; all columns as they are without a mapping."""
    return df.select(*(field(df, path).alias(out) for out, path in mapping.items())) if mapping else df


def json_lines(df: DataFrame) -> Column:
    """A document as compact JSON; fields without a value are left out."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))


def write_jsonl(df: DataFrame, path: str, mapping: Mapping[str, str] | None = None, compression: str | None = None, mode: str = "overwrite") -> None:
    mapped(df, mapping).write.mode(mode).option("compression", _codec("jsonl", compression)).option("ignoreNullFields", True).json(path)


def read_jsonl(spark: SparkSession, path: str, limit: int = 0, schema: StructType | None = None) -> DataFrame:
    """Lines that parse; a limit of 0 is none."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.limit(limit) if limit else df


def write_shards(df: DataFrame, path: str, shard_size: int = 10000, order_by: str = "doc_id") -> None:
    """Contiguous shards of a fixed size, one folder each.

    Ranks are summed over ranges of the order, so no task orders all rows; a shard then holds its own rows only.
    """
    if shard_size <= 0:
        raise ValueError("shard_size must be positive")
    ranged = df.repartitionByRange(F.col(order_by)).withColumn("_p", F.spark_partition_id())
    from textquarry.runtime import materialize

    ranged = materialize(ranged)
    per = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(order_by)) - 1
    out = ranged.withColumn("_k", rank).join(F.broadcast(per), "_p").withColumn("shard", F.floor((F.col("_before") + F.col("_k")) / shard_size).cast("int")).drop("_p", "_k", "_before")
    out.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


def validate_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """total, valid, empty and invalid lines, and whether the file is valid."""
    v = F.col("value")
    blank = F.trim(v) == ""
    ok = F.try_parse_json(v).isNotNull()
    out = spark.read.text(path).agg(F.count("*").alias("total_lines"), F.count_if(~blank & ok).alias("valid_lines"), F.count_if(blank).alias("empty_lines"), F.count_if(~blank & ~ok).alias("invalid_lines"))
    return out.withColumn("valid", F.col("invalid_lines") == 0)


def flattened(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON strings."""
    return df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields))


def narrowed(df: DataFrame) -> DataFrame:
    """Whole numbers in the smallest type that holds them; one aggregate, and nothing is lost."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.dataType.typeName() in ("long", "integer", "short")]
    if not whole:
        return df
    bounds = df.agg(*(x for c in whole for x in (F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b")))).first()
    kinds = (("byte", 7), ("short", 15), ("int", 31))
    for c in whole:
        a, b = bounds[f"{c}_a"], bounds[f"{c}_b"]
        if a is not None:
            df = df.withColumn(c, F.col(c).cast(next((k for k, n in kinds if -(1 << n) <= a and b < (1 << n)), "long")))
    return df


def write_parquet(df: DataFrame, path: str, mapping: Mapping[str, str] | None = None, compression: str = "snappy", partition_by: Sequence[str] = (), optimize: bool = False, as_strings: bool = False, mode: str = "overwrite", max_rows: int = 0) -> None:
    """Documents as Parquet; nested fields keep their types unless ``as_strings``."""
    df = mapped(df, mapping)
    df = flattened(df) if as_strings else df
    df = narrowed(df) if optimize else df
    if lacking := [c for c in partition_by if c not in df.columns]:
        raise ValueError(f"no such columns: {lacking}")
    w = df.write.mode(mode).option("compression", _codec("parquet", compression))
    w = w.option("maxRecordsPerFile", max_rows) if max_rows else w
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, condition: str | Column | None = None, limit: int | None = None) -> DataFrame:
    """Columns and conditions reach the scan."""
    df = spark.read.parquet(path)
    df = df.filter(condition) if condition is not None else df
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit else df


def schema_info(df: DataFrame) -> dict:
    return {"columns": df.columns, "types": dict(df.dtypes), "nullable": {f.name: f.nullable for f in df.schema.fields}, "rows": df.count()}


#: Bytes of input for each file that merge_parquet writes unless a number is given.
MERGED_BYTES = 256 << 20


def merge_parquet(spark: SparkSession, paths: Sequence[str], out: str, files: int | None = None) -> None:
    """Existing files together in a few, by their size; missing inputs are skipped, none at all is an error."""
    store = Storage(spark)
    paths = [p for p in paths if store.exists(p)]
    if not paths:
        raise ValueError("no files to merge")
    df = spark.read.parquet(paths[0])
    for p in paths[1:]:
        df = df.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    files = files or 1 + sum(f.size for p in paths for f in store.files(p)) // MERGED_BYTES
    df.coalesce(files).write.mode("overwrite").parquet(out)


def dataset_info(df: DataFrame, split_col: str = "split") -> dict:
    """Rows of each split and the fields' types."""
    counts = {r[0]: r[1] for r in df.groupBy(split_col).count().collect()}
    return {"splits": counts, "total": sum(counts.values()), "features": {n: k for n, k in df.dtypes if n != split_col}}


def write_splits(df: DataFrame, path: str, kind: str = "parquet", split_col: str = "split", compression: str | None = None) -> None:
    """A folder for each split, and dataset_info.json beside them for a dataset."""
    if kind not in ("jsonl", "parquet", "dataset"):
        raise ValueError(f"unknown format: {kind}")
    w = df.write.mode("overwrite").partitionBy(split_col)
    if kind == "jsonl":
        w.option("compression", _codec("jsonl", compression)).json(path)
        return
    w.option("compression", _codec("parquet", compression or "snappy")).parquet(path)
    if kind == "dataset":
        Storage(df.sparkSession).write(join(path, "dataset_info.json"), json.dumps(dataset_info(df, split_col), indent=2))


class BatchWriter:
    """Appends batches; the first replaces what was there."""

    def __init__(self, path: str, kind: str = "jsonl"):
        self.path, self.kind, self.batches = path, kind, 0

    def add(self, df: DataFrame, batch_id: int | None = None) -> None:
        """Also fits ``writeStream.foreachBatch``."""
        w = df.write.mode("append" if self.batches else "overwrite")
        w.json(self.path) if self.kind == "jsonl" else w.parquet(self.path)
        self.batches += 1


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
