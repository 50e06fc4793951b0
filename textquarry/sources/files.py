"""Readers of files as documents: one lazy DataFrame for each format, with the path of every record as ``source``."""

from __future__ import annotations

import os
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from textquarry.functions.text import strip
from textquarry.operators.splits import union_all
from textquarry.sources.storage import Storage

SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".txt": "txt", ".parquet": "parquet", ".xml": "xml"}


def _source() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:(?://)?", "")


def _labelled(df: DataFrame, kind: str, *cols: Column) -> DataFrame:
    return df.select(*cols, _source().alias("source"), F.lit(kind).alias("format"))


def read_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A file is one value: ``content`` is a variant."""
    return _labelled(spark.read.text(path, wholetext=True), "json", F.try_parse_json("value").alias("content"))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | None = None, malformed: bool = False) -> DataFrame:
    """A line is a document; its own source and format give way to the file's. Blank lines are skipped.

    Malformed lines are dropped, or are the only rows with ``malformed=True``, as ``_corrupt_record``.
    """
    lines = spark.read.text(path).select("value", _source().alias("source")).filter(strip(F.col("value")) != "")
    good = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    if malformed:
        return lines.filter(~good).select(F.col("value").alias("_corrupt_record"), "source")
    lines = lines.filter(good)
    if schema is None:
        schema = spark.read.option("mode", "DROPMALFORMED").json(path).schema  # one pass, as schema inference is
    own = [f.name for f in schema.fields if f.name not in ("source", "format")]
    return lines.select(F.from_json("value", schema).alias("d"), "source").select(*(F.col(f"d.{n}").alias(n) for n in own), "source", F.lit("jsonl").alias("format"))


def _rows(df: DataFrame, kind: str) -> DataFrame:
    data = [c for c in df.columns]
    return _labelled(df.select("*", "_metadata"), kind, F.struct(*(F.col(c) for c in data)).alias("content"))


def read_csv(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """``content`` holds a row's columns; types are inferred unless a schema is given."""
    schema = options.pop("schema", None)
    reader = spark.read.options(header=True, multiLine=True, escape='"', **({} if schema else {"inferSchema": True}), **options)
    return _rows((reader.schema(schema) if schema else reader).csv(path), "csv")


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return _rows(df.select(*columns) if columns else df, "parquet")


def decoded(spark: SparkSession, path: str | Sequence[str], encoding: str = "auto") -> DataFrame:
    """(source, value) of whole files in an encoding; "auto" tries UTF-8, then cp1252."""

    @F.pandas_udf(StringType())
    def decode(files: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            if encoding != "auto":
                return raw.decode(encoding, "replace")
            try:
                return raw.decode("utf-8")
            except UnicodeDecodeError:
                return raw.decode("cp1252", "replace")

        return files.map(one)

    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_replace("path", "^file:(?://)?", "").alias("source"), decode("content").alias("value"))


def read_txt(spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """A document for each stripped line that is not blank; line_number counts from 1 and counts blank lines."""
    whole = spark.read.text(path, wholetext=True).select(_source().alias("source"), "value") if encoding == "utf-8" else decoded(spark, path, encoding)
    whole = whole.select("source", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("at", "line"))
    return whole.select(strip(F.col("line")).alias("text"), "source", F.lit("txt").alias("format"), (F.col("at") + 1).alias("line_number")).filter("text <> ''")


def read_xml(spark: SparkSession, path: str | Sequence[str], text_element: str = "text") -> DataFrame:
    """A document for each such element, at any depth, that holds text; a file that cannot be parsed gives none."""
    from xml.etree import ElementTree

    from pyspark.sql.types import ArrayType, MapType, StructField

    kind = ArrayType(StructType([StructField("text", StringType()), StructField("tag", StringType()), StructField("attributes", MapType(StringType(), StringType()))]))

    @F.pandas_udf(kind)
    def elements(files: pd.Series) -> pd.Series:
        def one(raw: str) -> list:
            try:
                root = ElementTree.fromstring(raw)
            except ElementTree.ParseError:
                return []
            return [{"text": e.text, "tag": e.tag, "attributes": dict(e.attrib)} for e in root.iter(text_element) if e.text]

        return files.map(one)

    whole = spark.read.text(path, wholetext=True)
    return _labelled(whole.select("_metadata", F.explode(elements("value")).alias("e")), "xml", F.col("e.text").alias("text"), F.col("e.tag").alias("tag"), F.col("e.attributes").alias("attributes"))


_READERS = {"json": read_json, "jsonl": read_jsonl, "csv": read_csv, "txt": read_txt, "parquet": read_parquet, "xml": read_xml}


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Dispatch on the suffix."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file format: {suffix}")
    if not any(c in path for c in "*?[") and not Storage(spark).exists(path):
        raise FileNotFoundError(path)
    return _READERS[SUFFIXES[suffix]](spark, path, **options)


def read_directory(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = True, text_field: str | None = "text") -> DataFrame | None:
    """All files of known suffixes below a directory, one scan for each format; fields that a format lacks are null.

    ``text_field`` of structured content is promoted to ``text``. Nothing found gives None.
    """
    import fnmatch

    found: dict[str, list[str]] = {}
    for f in Storage(spark).files(directory, recursive):
        if fnmatch.fnmatch(os.path.basename(f.path), pattern) and (kind := SUFFIXES.get(os.path.splitext(f.path)[1].lower())):
            found.setdefault(kind, []).append(f.path)
    parts = []
    for kind, paths in sorted(found.items()):
        df = _READERS[kind](spark, paths)
        if "content" in df.columns:
            df = promote_text(df, text_field) if text_field else df
            df = df.withColumn("content", F.to_json("content"))
        parts.append(df)
    return union_all(*parts) if parts else None


def promote_text(df: DataFrame, text_field: str = "text") -> DataFrame:
    """``text`` from a field of ``content``, whether a struct, a map or a variant; null where it has none."""
    kind = df.schema["content"].dataType.typeName()
    if kind == "struct":
        has = text_field in df.schema["content"].dataType.fieldNames()
        return df.withColumn("text", F.col(f"content.{text_field}").cast("string") if has else F.lit(None).cast("string"))
    if kind == "map":
        return df.withColumn("text", F.try_element_at("content", F.lit(text_field)))
    return df.withColumn("text", F.try_variant_get("content", f"$.{text_field}", "string"))


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """name, path, size, size_mb, modified, extension, encoding of every file; the encoding is tried on the first 10 KB."""

    @F.pandas_udf(StringType())
    def encoding(heads: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            for cut in range(4 if len(raw) == 10240 else 1):  # a character may be cut at the end of the head
                try:
                    raw[: len(raw) - cut].decode("utf-8")
                    return "utf-8"
                except UnicodeDecodeError:
                    continue
            return "cp1252"

        return heads.map(one)

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.regexp_replace("path", "^file:(?://)?", "")
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), plain.alias("path"), F.col("length").alias("size"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), encoding(F.substring("content", 1, 10240)).alias("encoding"))
