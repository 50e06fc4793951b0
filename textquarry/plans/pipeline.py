"""The corpus pipeline: a configuration becomes stages over DataFrames, each written once and resumable."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import metrics
from textquarry.functions.cleaning import TextCleaner
from textquarry.functions.language import is_language
from textquarry.operators import augmentation, filters, splits, synthetic, tokenization, validation
from textquarry.operators import dedup as duplicates
from textquarry.plans.config import Config
from textquarry.plans.versioning import DatasetTracker, Stages
from textquarry.sources import api, files, sinks, web
from textquarry.sources.storage import Storage, join
from textquarry.streaming import monitoring


def make_filter(own: dict[str, Any]) -> filters.Filter:
    """A filter on the text alone; filters that score whole tables are run by ``apply_filter``."""
    kind = own["type"]
    if kind == "length":
        return filters.length_filter(own.get("min_length", 0), own.get("max_length"), own.get("unit", "characters"))
    if kind == "language":
        return filters.language_filter(own["languages"], own.get("confidence", 0.7))
    if kind == "toxicity":
        return filters.toxicity_filter(own.get("max_toxicity", 0.3))
    if kind == "content_type":
        return filters.content_type_filter(own["allowed"], own.get("confidence", 0.6))
    if kind == "composite":
        return filters.composite([make_filter(x) for x in own["filters"]], own.get("logic", "and"))
    raise ValueError(f"unknown filter: {kind}")


def apply_filter(df: DataFrame, own: dict[str, Any]) -> DataFrame:
    if own["type"] == "quality":
        return filters.quality_filter(df, own.get("min_score", 0.5))
    if own["type"] == "perplexity":
        return filters.perplexity_filter(df, own.get("max_perplexity", 1000.0))
    if own["type"] == "duplicate":
        return filters.duplicate_filter(df, own.get("similarity", 0.9))
    return make_filter(own).apply(df)


def identified(df: DataFrame) -> DataFrame:
    """The documents with a ``doc_id`` each; none is dropped, and a rerun over the same sources gives the same ids.

    Own ids stay where every document has one and none is given twice. Else the id is a hash of the source (``_from``),
    of what the document says and, among equal documents, of a running number; an own id is kept as ``own_id``.
    """
    if "doc_id" in df.columns:
        n = df.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
        if n["rows"] == n["ids"]:
            return df.drop("_from")
        df = df.withColumn("own_id", F.col("doc_id").cast("string")).drop("doc_id")
    cols = df.columns
    # equal documents meet as one row and a count, so a text that fills a third of the rows weighs nothing in the shuffle
    equal = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    runs = equal.withColumn("_run", F.explode(F.expr("sequence(0, (_n - 1) div 4096)")))
    each = runs.withColumn("_k", F.explode(F.expr("sequence(_run * 4096 + 1, least((_run + 1) * 4096, _n))")))
    return each.select(F.xxhash64(F.to_json(F.struct(*cols, "_k"))).alias("doc_id"), *(c for c in cols if c != "_from"))


class Pipeline:
    """ingest, preprocess, quality, augment, format; then a version."""

    def __init__(self, spark: SparkSession, config: Config):
        if problems := config.problems():
            raise ValueError("; ".join(problems))
        self.spark, self.config = spark, config
        self.out = config.get("project.output_dir")
        self.seed = config.get("project.seed", 42)
        self.dropped: dict[str, int] = {}
        self.metrics = monitoring.Metrics()
        self._begun: list[tuple[str, float]] = []

    def _key(self) -> str:
        """Changes with the configuration and with the files read."""
        stamps = []
        for s in self.config.get("ingestion.sources"):
            stamps += [list(f) for f in Storage(self.spark).files(s["path"])] if s.get("path") else []
        return hashlib.sha256(json.dumps([self.config.tree, stamps], sort_keys=True, default=str).encode()).hexdigest()

    def ingest(self, _: DataFrame | None) -> DataFrame:
        parts, seen = [], []
        for s in self.config.get("ingestion.sources"):
            seen.append(json.dumps(s, sort_keys=True, default=str))
            if s["type"] == "file":
                path = s["path"]
                df = files.read_directory(self.spark, path, s.get("pattern", "*")) if Storage(self.spark).is_folder(path) else files.read_file(self.spark, path)
                if df is None:
                    continue
                if "content" in df.columns and "text" not in df.columns:
                    df = files.promote_text(df, self.config.get("ingestion.text_field"))
            elif s["type"] == "table":
                df = self.spark.read.parquet(s["path"])
            elif s["type"] == "web":
                self.spark.dataSource.register(web.WebSource)
                df = web.page_documents(web.parse_pages(self.spark.read.format("web").option("urls", " ".join(s["urls"])).load()))
            else:
                df = api.documents(self.spark.read.json(s["path"]))
            keep = [c for c in ("doc_id", "text", "source", "format", "title", "line_number", "lang") if c in df.columns]
            # required fields travel along to be validated, nested ones as JSON
            kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
            own = [c for c in self.config.get("quality.required_fields") if c in kinds and c not in keep]
            parts.append(df.select(*keep, *(F.to_json(c).alias(c) if kinds[c] in ("struct", "map", "array", "variant") else F.col(c) for c in own), F.lit(f"{seen[-1]}#{seen.count(seen[-1])}").alias("_from")))
        if not parts:
            raise ValueError("no documents found")
        if len({dict(p.dtypes)["doc_id"] for p in parts if "doc_id" in p.columns}) > 1:
            parts = [p.withColumn("doc_id", F.col("doc_id").cast("string")) if "doc_id" in p.columns else p for p in parts]
        out = splits.union_all(*parts)
        self.dropped["no_text"] = out.filter("text is null").count()
        return identified(out.filter("text is not null"))

    def preprocess(self, df: DataFrame) -> DataFrame:
        own = self.config.get("preprocessing")
        df = TextCleaner(**own["cleaning"]).clean(df, ("text",))
        if own["languages"]:
            df = df.filter(is_language(F.col("text"), own["languages"]))
        options = {k: v for k, v in own["dedup"].items() if k != "methods"}
        df = duplicates.dedup(df, own["dedup"].get("methods", ()), **options)
        if own["tokenizer"]:
            tokens = tokenization.create_tokenizer(own["tokenizer"].get("type", "simple")).tokenize(F.col("text"))
            df = df.withColumn("num_tokens", F.size(tokens).cast("long"))
        return df

    def quality(self, df: DataFrame) -> DataFrame:
        for own in self.config.get("quality.filters"):
            df = apply_filter(df, own)
        least = self.config.get("quality.min_quality_score", 0.0)
        return filters.quality_filter(df, least) if least else df

    def quality_report(self, df: DataFrame) -> dict[str, Any]:
        """Validation and quality metrics of all documents that the quality stage kept; nothing is dropped by either."""
        report: dict[str, Any] = {"validation": None}
        if self.config.get("quality.validate"):
            checked = validation.validate(df, self.config.get("quality.required_fields"))
            report["validation"] = validation.validity(checked).first().asDict() | {"errors": {r.error: r["count"] for r in validation.error_summary(checked).collect()}}
        measured = metrics.all_metrics(df, "text", ("text",)).withColumn("lexical_diversity", metrics.lexical_diversity("text"))
        summary = splits.metric_summary(measured, [c for c in measured.columns if c != "text"])
        report["metrics"] = {r.metric: {"mean": r.mean, "min": r.min, "max": r.max} for r in summary.collect()}  # a row for each metric
        return report

    def augment(self, df: DataFrame) -> DataFrame:
        own = self.config.get("augmentation")
        if not own["enabled"]:
            return df
        parts = [df]
        if "paraphrase" in own["techniques"]:
            parts.append(augmentation.paraphrases(df, own["paraphrases_per_doc"], own["intensity"], self.seed).filter("is_paraphrase"))
        if "back_translation" in own["techniques"]:
            parts.append(augmentation.back_translations(df, own["ratio"], own["variations"], seed=self.seed).filter("is_back_translation"))
        if "synthetic" in own["techniques"] and own["synthetic"]:
            made = synthetic.as_documents(synthetic.mixed(self.spark, own["synthetic"], {"text": 0.5, "instruction": 0.5}, self.seed))
            parts.append(made.select(F.xxhash64("content_type", "id").alias("doc_id"), "text", F.lit("synthetic").alias("source")))
        return splits.union_all(*parts)

    def format(self, df: DataFrame) -> DataFrame:
        own = self.config.get("output")
        rowed = df.withColumn("_row", F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)))
        field = own["stratify_by"]
        done = splits.stratified_split(rowed, field, own["splits"], "_row", self.seed) if field else splits.random_split(rowed, own["splits"], "_row", self.seed)
        return done.drop("_row")

    def _timed(self, name: str, stage: Callable) -> Callable:
        def run(df: DataFrame | None) -> DataFrame:
            self._begun.append((name, time.perf_counter()))
            return stage(df)

        return run

    def _quality_of(self, stages: Stages) -> dict[str, Any]:
        """The report on the table of the quality stage; taken from its file where the stage was not run again."""
        path = stages.path("quality") + ".json"
        store = Storage(self.spark)
        if store.exists(path) and "quality" not in dict(self._begun):
            return json.loads(store.read(path))
        report = self.quality_report(self.spark.read.parquet(stages.path("quality")))
        store.write(path, json.dumps(report))
        return report

    def _monitored(self, stages: Stages, quality: dict[str, Any]) -> dict[str, Any]:
        """What was recorded, and the alerts that it meets; rules on metrics that nothing records are named."""
        ends = [*(at for _, at in self._begun[1:]), self._ended]
        for (name, at), end in zip(self._begun, ends, strict=False):  # stages that were run now
            self.metrics.record(f"stage.{name}.duration", end - at)
        for name, status in stages.status().items():
            if status == "done":
                self.metrics.record(f"stage.{name}.documents", self.spark.read.parquet(stages.path(name)).count())
        for name, n in self.dropped.items():
            self.metrics.record(f"dropped.{name}", n)
        for name, n in (quality["validation"] or {}).items():
            if name != "errors":
                self.metrics.record(f"quality.{name}", n)
        for name, own in quality["metrics"].items():
            for part, value in own.items():
                if value is not None:
                    self.metrics.record(f"quality.{name}.{part}", value)
        rules = [*monitoring.DEFAULT_RULES, *(monitoring.Rule(a.get("name", a["metric"]), a["metric"], a["operator"], a["threshold"]) for a in self.config.get("monitoring.alerts"))]
        fired = monitoring.Alerts(self.metrics, rules).check()
        for f in fired:
            monitoring.log.warning("alert %(rule)s: %(metric)s is %(value)s, threshold %(threshold)s", f)
        names = self.metrics.names()
        return {"alerts": fired, "not_recorded": sorted({r.metric for r in rules} - set(names)), "latest": {n: self.metrics.series(n)[-1][1] for n in names}}

    def run(self, resume: bool = True) -> dict[str, Any]:
        watch = monitoring.SystemMonitor(self.metrics) if self.config.get("monitoring.enabled") else None
        if watch:
            watch.sample()
            watch.start()
        try:
            return self._run(resume, watch)
        finally:
            if watch:
                watch.stop()

    def _run(self, resume: bool, watch: monitoring.SystemMonitor | None) -> dict[str, Any]:
        self._begun.clear()
        stages = Stages(self.spark, join(self.out, "stages"), self._key())
        steps = {"ingest": self.ingest, "preprocess": self.preprocess, "quality": self.quality, "augment": self.augment, "format": self.format}
        done = stages.run({n: self._timed(n, f) for n, f in steps.items()}, resume=resume)
        self._ended = time.perf_counter()
        quality = self._quality_of(stages)
        path = join(self.out, "dataset")
        sinks.write_splits(done, path, self.config.get("output.format"), compression=self.config.get("output.compression"))
        version = DatasetTracker(self.spark, join(self.out, "versions")).create(done, self.config.get("project.name"))
        counts = {r.split: r["count"] for r in done.groupBy("split").count().collect()}
        told = self._monitored(stages, quality) if watch else None
        return {"path": path, "version": version, "splits": counts, "stages": stages.status(), "dropped": self.dropped, "quality": quality, "monitoring": told}
