"""Command line: process, clean, assess, augment; config create and validate; dataset versions, export and compare."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textquarry.functions.cleaning import TextCleaner
from textquarry.functions.language import is_language
from textquarry.operators import augmentation, validation
from textquarry.plans.config import Config
from textquarry.plans.pipeline import Pipeline
from textquarry.plans.versioning import DatasetTracker
from textquarry.sources import files, sinks
from textquarry.sources.storage import Storage


def _documents(spark: SparkSession, path: str):
    
    df = files.read_directory(spark, path) if Storage(spark).is_folder(path) else files.read_file(spark, path)
    if "content" in df.columns and "text" not in df.columns:
        df = files.promote_text(df)
    return df if "doc_id" in df.columns else df.withColumn("doc_id", F.xxhash64("source", F.coalesce("text", F.lit(""))))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textquarry")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("process")
    c.add_argument("config")
    c.add_argument("--no-resume", action="store_true")
    c = sub.add_parser("clean")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--language", action="append", default=[])
    c.add_argument("--min-length", type=int, default=0)
    c = sub.add_parser("assess")
    c.add_argument("input")
    c.add_argument("--report")
    c.add_argument("--format", default="json", choices=("json", "html"))
    c = sub.add_parser("augment")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--technique", default="paraphrase", choices=("paraphrase", "back_translation"))
    c = sub.add_parser("config")
    c.add_argument("action", choices=("create", "validate"))
    c.add_argument("path")
    c = sub.add_parser("dataset")
    c.add_argument("action", choices=("list-versions", "export-version", "compare"))
    c.add_argument("directory")
    c.add_argument("arguments", nargs="*")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "config":
        if a.action == "create":
            Config().save(a.path)
            return 0
        problems = Config.load(a.path).problems()
        print("\n".join(problems) or "valid")
        return int(bool(problems))
    spark = spark or SparkSession.builder.appName("textquarry").getOrCreate()
    if a.command == "process":
        print(json.dumps(Pipeline(spark, Config.load(a.config)).run(not a.no_resume), default=str))
    elif a.command == "clean":
        df = TextCleaner(min_length=a.min_length).clean(_documents(spark, a.input), ("text",)).filter("text is not null")
        sinks.write_jsonl(df.filter(is_language(F.col("text"), a.language)) if a.language else df, a.output)
    elif a.command == "assess":
        report = validation.comprehensive(_documents(spark, a.input), sample_size=None)
        if a.report:
            validation.export_report(report, a.report, a.format)
        print(json.dumps({k: v for k, v in report.items() if k != "schema"}, default=str))
    elif a.command == "augment":
        f = augmentation.paraphrases if a.technique == "paraphrase" else augmentation.back_translations
        sinks.write_jsonl(f(_documents(spark, a.input).filter("text is not null")), a.output)
    else:
        tracker = DatasetTracker(spark, a.directory)
        if a.action == "list-versions":
            for v in tracker.list():
                print(v.version_id, v.documents, ",".join(v.tags))
        elif a.action == "export-version":
            tracker.export(a.arguments[0], a.arguments[1])
        else:
            print(json.dumps(tracker.compare(a.arguments[0], a.arguments[1])))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
