"""Validation of documents: error arrays as expressions, field statistics and schemas from aggregates."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

from textquarry.functions import text as T

#: Fields that hold text and metadata.
TEXT_FIELDS = ("text", "content", "body", "title", "description", "summary")
METADATA_FIELDS = ("metadata", "attributes", "properties", "tags")
LONGEST_LINE, LONGEST_METADATA = 10_000, 100_000


def structure_errors(df: DataFrame, required: Sequence[str], optional: Sequence[str] | None = None) -> Column:
    """Missing, null and unexpected fields of each document."""
    found = set(df.columns)
    errors = [F.lit(f"Missing required field: {f}") if f not in found else F.when(F.col(f).isNull(), F.lit(f"Required field is None: {f}")) for f in required]
    if optional is not None:
        errors += [F.when(F.col(f).isNotNull(), F.lit(f"Unexpected field: {f}")) for f in df.columns if f not in {*required, *optional}]
    return F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")


def text_errors(name: str) -> Column:
    """Errors of a text field; null text is no error of this kind."""
    t = F.col(name)
    lines = F.split(t, "\n")
    long = F.filter(F.transform(lines, lambda x, i: F.when(F.length(x) > LONGEST_LINE, i + 1)), lambda i: i.isNotNull())
    return F.array_compact(F.array(
        F.when(T.strip(t) == "", F.lit(f"Empty text field: {name}")),
        F.when(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit(f"Control characters in field: {name}")),
        F.when(~F.is_valid_utf8(t), F.lit(f"Invalid encoding in field: {name}")),
        F.when(F.size(long) > 0, F.concat(F.lit(f"Very long lines in field: {name} at "), F.array_join(F.slice(long, 1, 5).cast("array<string>"), ", "))),
    ))


def metadata_errors(name: str) -> Column:
    size = F.length(F.to_json(F.struct(F.col(name))))
    return F.array_compact(F.array(F.when(F.col(name).isNotNull() & (size > LONGEST_METADATA), F.lit(f"Metadata too large: {name}"))))


def document_errors(df: DataFrame, required: Sequence[str] = (), optional: Sequence[str] | None = None) -> Column:
    """All errors of a document: structure where fields are required, then text fields, then metadata fields."""
    kinds = dict(df.dtypes)
    parts = [structure_errors(df, required, optional)] if required else []
    parts += [text_errors(f) for f in TEXT_FIELDS if kinds.get(f) == "string"]
    parts += [F.array(F.when(F.col(f).isNotNull(), F.lit(f"Field is not text: {f}"))) for f in TEXT_FIELDS if f in kinds and kinds[f] != "string"]
    parts += [metadata_errors(f) for f in METADATA_FIELDS if f in kinds]
    return F.array_compact(F.concat(*parts)) if parts else F.array().cast("array<string>")


def validate(df: DataFrame, required: Sequence[str] = (), optional: Sequence[str] | None = None) -> DataFrame:
    """The documents with their ``errors``."""
    return df.withColumn("errors", document_errors(df, required, optional))


def error_summary(validated: DataFrame) -> DataFrame:
    """(error, count) by what stands before the colon."""
    return validated.select(F.explode("errors").alias("e")).groupBy(F.split_part("e", F.lit(":"), F.lit(1)).alias("error")).agg(F.count("*").alias("count"))


def validity(validated: DataFrame) -> DataFrame:
    """documents, valid, invalid."""
    return validated.agg(F.count("*").alias("documents"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"))


def json_type(t: DataType) -> str:
    """The JSON name of a column's type."""
    if isinstance(t, StringType):
        return "string"
    if isinstance(t, BooleanType):
        return "boolean"
    if isinstance(t, NumericType):
        return "integer" if t.typeName() in ("byte", "short", "integer", "long") else "number"
    if isinstance(t, ArrayType):
        return "array"
    if isinstance(t, (MapType, StructType)):
        return "object"
    return "string"


def field_statistics(df: DataFrame) -> DataFrame:
    """A row for each field: type, presence, and for strings shortest, longest, mean and upper median length.

    One aggregate over all fields; the median comes from the counts of lengths, never from a list of all of them.
    """
    fields = [(f.name, json_type(f.dataType)) for f in df.schema.fields]
    n = F.count("*")
    one = df.agg(n.alias("n"), *(F.count(f).alias(f"c{i}") for i, (f, _) in enumerate(fields)), *(x for i, (f, k) in enumerate(fields) if k == "string" and dict(df.dtypes)[f] == "string" for x in (F.min(F.length(f)).alias(f"a{i}"), F.max(F.length(f)).alias(f"b{i}"), F.avg(F.length(f)).alias(f"m{i}"))))
    text = [i for i, (f, k) in enumerate(fields) if k == "string" and dict(df.dtypes)[f] == "string"]
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("type"), F.col(f"c{i}").alias("present"), F.round(T.ratio(F.col(f"c{i}"), F.col("n")), 6).alias("presence"), (F.col(f"a{i}") if i in text else F.lit(None)).cast("long").alias("min_length"), (F.col(f"b{i}") if i in text else F.lit(None)).cast("long").alias("max_length"), F.round((F.col(f"m{i}") if i in text else F.lit(None)).cast("double"), 6).alias("avg_length")) for i, (f, k) in enumerate(fields)))
    base = one.select(F.inline(rows))
    if not text:
        return base.withColumn("median_length", F.lit(None).cast("long"))
    lengths = df.select(F.explode(F.array(*(F.struct(F.lit(fields[i][0]).alias("field"), F.length(fields[i][0]).cast("long").alias("length")) for i in text))).alias("x")).select("x.*").filter("length is not null")
    counted = lengths.groupBy("field", "length").agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    upto = F.sum("k").over(Window.partitionBy("field").orderBy("length"))  # as many rows as there are lengths
    total = F.sum("k").over(Window.partitionBy("field"))
    median = counted.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("field").agg(F.min("length").alias("median_length"))
    return base.join(F.broadcast(median), "field", "left")  # a row for each field


def create_schema(df: DataFrame, first: int = 100, order_by: str = "doc_id") -> dict[str, Any]:
    """A JSON schema from the first documents: types, null where a field has one, bounds of lengths of strings."""
    some = df.orderBy(order_by).limit(first) if order_by in df.columns else df.limit(first)
    stats = some.agg(F.count("*").alias("n"), *(F.count(f).alias(f"c_{f}") for f in df.columns)).first()
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    five = some.select(*texts).limit(5).collect() if texts else []
    properties: dict[str, Any] = {}
    for f in df.schema.fields:
        kind = json_type(f.dataType)
        own: dict[str, Any] = {"type": kind if stats[f"c_{f.name}"] == stats["n"] else [kind, "null"]}
        if f.name in texts:
            longest = max((len(r[f.name]) for r in five if r[f.name] is not None), default=0)
            own["minLength"] = 1
            if 0 < longest < 1000:
                own["maxLength"] = 2 * longest
        properties[f.name] = own
    required = [f.name for f in df.schema.fields if stats[f"c_{f.name}"] == stats["n"]]
    return {"type": "object", "properties": properties, "required": required}


def schema_errors(df: DataFrame, schema: dict[str, Any]) -> Column:
    """Errors of a document against a schema."""
    kinds = {f.name: json_type(f.dataType) for f in df.schema.fields}
    errors = [F.lit(f"Missing required field: {f}") if f not in kinds else F.when(F.col(f).isNull(), F.lit(f"Missing required field: {f}")) for f in schema.get("required", [])]
    for name, own in schema.get("properties", {}).items():
        if name not in kinds:
            continue
        allowed = own["type"] if isinstance(own["type"], list) else [own["type"]]
        if kinds[name] not in allowed and not (kinds[name] == "integer" and "number" in allowed):
            errors.append(F.when(F.col(name).isNotNull(), F.lit(f"Wrong type of field: {name}")))
        if "minLength" in own and kinds[name] == "string":
            errors.append(F.when(F.length(name) < own["minLength"], F.lit(f"Too short: {name}")))
        if "maxLength" in own and kinds[name] == "string":
            errors.append(F.when(F.length(name) > own["maxLength"], F.lit(f"Too long: {name}")))
    return F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")


def quality_of(error_rate: float, schema_error_rate: float) -> float:
    return max(0.0, min(1.0, 1 - 0.5 * error_rate - 0.3 * schema_error_rate))


def comprehensive(df: DataFrame, schema: dict[str, Any] | None = None, auto: bool = True, sample_size: int | None = 1000, id_col: str = "doc_id", seed: int = 42) -> dict[str, Any]:
    """A report: schema validation of all documents, data validation of a seeded sample (all with None), score, advice."""
    schema = schema or (create_schema(df, order_by=id_col) if auto else None)
    total = df.count()
    bad_schema = df.filter(F.size(schema_errors(df, schema)) > 0).count() if schema and total else 0
    some = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample_size) if sample_size and sample_size < total else df
    checked = validate(some)
    counts = validity(checked).first()
    summary = {r.error: r["count"] for r in error_summary(checked).collect()}
    rate = counts.invalid / counts.documents if counts.documents else 0.0
    schema_rate = bad_schema / total if total else 0.0
    report = {"documents": total, "checked": counts.documents, "valid": counts.valid, "invalid": counts.invalid, "error_summary": summary, "schema": schema, "schema_errors": bad_schema, "quality_score": quality_of(rate, schema_rate)}
    report["recommendations"] = recommendations(report, rate, schema_rate)
    return report


def recommendations(report: dict[str, Any], rate: float, schema_rate: float) -> list[str]:
    advice = []
    if rate > 0.1:
        advice.append("More than a tenth of the documents have errors; clean them before use.")
    if schema_rate > 0.05:
        advice.append("Documents deviate from the schema; bring fields to one form.")
    names = " ".join(report["error_summary"])
    if "Empty text" in names:
        advice.append("Remove documents without text.")
    if "Control characters" in names:
        advice.append("Strip control characters.")
    if "encoding" in names:
        advice.append("Repair the encoding of the files.")
    return advice or ["No action needed."]


def export_report(report: dict[str, Any], path: str, kind: str = "json") -> None:
    if kind == "json":
        body = json.dumps(report, ensure_ascii=False, indent=2, default=str)
    elif kind == "html":
        rows = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(str(v))}</td></tr>" for k, v in report.items())
        body = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Validation</title></head><body><table>{rows}</table></body></html>"
    else:
        raise ValueError(f"unknown format: {kind}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)
