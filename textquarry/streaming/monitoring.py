"""Metric series: windows over batches and streams, alerts, and what a query tells while it runs."""

from __future__ import annotations

import functools
import json
import logging
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("textquarry")
OPERATORS = {"gt": lambda v, t: v > t, "lt": lambda v, t: v < t, "eq": lambda v, t: F.abs(v - t) < 0.001}


def metric_statistics(series: DataFrame, name_col: str = "name", value_col: str = "value", time_col: str = "ts", since: Column | None = None) -> DataFrame:
    """count, min, max, mean, latest and true median of each metric, over a trailing window where ``since`` is given."""
    rows = series.filter(F.col(time_col) >= since) if since is not None else series
    return rows.groupBy(F.col(name_col).alias("name")).agg(F.count(value_col).alias("count"), F.min(value_col).alias("min"), F.max(value_col).alias("max"), F.avg(value_col).alias("mean"), F.max_by(value_col, F.struct(time_col, value_col)).alias("latest"), F.median(value_col).alias("median"))


def windowed(series: DataFrame, length: str = "5 minutes", slide: str | None = None, name_col: str = "name", value_col: str = "value", time_col: str = "ts", watermark: str | None = None) -> DataFrame:
    """Statistics of each metric and window; the same plan runs on a stream, where late rows end with the watermark."""
    rows = series.withWatermark(time_col, watermark) if watermark else series
    by = rows.groupBy(F.window(time_col, length, slide) if slide else F.window(time_col, length), F.col(name_col).alias("name"))
    out = by.agg(F.count("*").alias("count"), F.min(value_col).alias("min"), F.max(value_col).alias("max"), F.sum(value_col).alias("sum"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "name", "count", "min", "max", "sum")


def sessions(series: DataFrame, key_col: str, gap: str = "30 minutes", time_col: str = "ts", watermark: str | None = None) -> DataFrame:
    """Runs of events of one key without a longer pause."""
    rows = series.withWatermark(time_col, watermark) if watermark else series
    out = rows.groupBy(F.session_window(time_col, gap), key_col).agg(F.count("*").alias("events"))
    return out.select(key_col, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    operator: str
    threshold: float


def alerts(statistics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, metric, value, threshold) for every rule that the latest value of its metric meets; rules are few and written by hand."""
    parts = []
    for r in rules:
        if r.operator not in OPERATORS:
            raise ValueError(f"unknown operator: {r.operator}")
        parts.append(F.when((F.col("name") == r.metric) & OPERATORS[r.operator](F.col("latest"), r.threshold), F.struct(F.lit(r.name).alias("rule"), F.col("name").alias("metric"), F.col("latest").cast("double").alias("value"), F.lit(float(r.threshold)).alias("threshold"))))
    return statistics.select(F.inline(F.array_compact(F.array(*parts))))


class Metrics:
    """A bounded series for each name on the driver; safe for threads."""

    def __init__(self, history: int = 1000):
        self._lock, self._history = threading.Lock(), history
        self._series: dict[str, deque] = {}

    def record(self, name: str, value: float, tags: Mapping[str, str] | None = None, at: float | None = None) -> None:
        with self._lock:
            self._series.setdefault(name, deque(maxlen=self._history)).append((at if at is not None else time.time(), float(value), dict(tags or {})))

    def series(self, name: str) -> list[tuple[float, float, dict]]:
        with self._lock:
            return list(self._series.get(name, ()))

    def names(self) -> list[str]:
        with self._lock:
            return sorted(self._series)

    def clear(self, name: str | None = None) -> None:
        with self._lock:
            self._series.pop(name, None) if name else self._series.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, at, v, t) for n in self.names() for at, v, t in self.series(n)]
        df = spark.createDataFrame(rows, "name string, at double, value double, tags map<string,string>")
        return df.select("name", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"), "value", "tags")

    @contextmanager
    def operation(self, name: str, items: int = 0) -> Iterator[None]:
        """Duration, throughput and outcome of a block."""
        start, ok = time.perf_counter(), 1.0
        try:
            yield
        except BaseException:
            ok = 0.0
            raise
        finally:
            took = time.perf_counter() - start
            self.record(f"operation.{name}.duration", took)
            self.record(f"operation.{name}.ok", ok)
            if items:
                self.record(f"operation.{name}.throughput", items / max(took, 1e-9))

    def export(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({n: [{"at": at, "value": v, "tags": t} for at, v, t in self.series(n)] for n in self.names()}, f)


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """``df`` that tells its measures once an action has run over it; no pass of its own."""
    o = Observation(name)
    return df.observe(o, *(c.alias(n) for n, c in measures.items())), o


class Alerts:
    """Rules on the latest values; a handler that fails is logged and does not stop the others."""

    def __init__(self, metrics: Metrics, rules: Sequence[Rule] = ()):
        self.metrics, self.rules = metrics, list(rules)
        self.handlers: list[Callable[[dict], None]] = []

    def check(self) -> list[dict]:
        fired = []
        tests = {"gt": lambda v, t: v > t, "lt": lambda v, t: v < t, "eq": lambda v, t: abs(v - t) < 0.001}
        for r in self.rules:
            s = self.metrics.series(r.metric)
            if s and tests[r.operator](s[-1][1], r.threshold):
                fired.append({"rule": r.name, "metric": r.metric, "value": s[-1][1], "threshold": r.threshold})
        for f in fired:
            for h in self.handlers:
                try:
                    h(f)
                except Exception:
                    log.exception("an alert handler failed")
        return fired


class SystemMonitor:
    """CPU, memory and disk of the driver's machine, every few seconds in a daemon thread."""

    def __init__(self, metrics: Metrics, interval: float = 5.0):
        self.metrics, self.interval = metrics, interval
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def sample(self) -> None:
        try:
            import psutil
        except ImportError:
            return
        self.metrics.record("system.cpu", psutil.cpu_percent())
        self.metrics.record("system.memory", psutil.virtual_memory().percent)
        self.metrics.record("system.disk", psutil.disk_usage("/").percent)

    def start(self) -> None:
        def run() -> None:
            while not self._stop.wait(self.interval):
                self.sample()

        self._stop.clear()
        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join(self.interval + 1)


DEFAULT_RULES = (Rule("cpu", "system.cpu", "gt", 90), Rule("memory", "system.memory", "gt", 90), Rule("disk", "system.disk", "gt", 90))


class QualityMonitor:
    """Shares and sizes of a document table as metrics ``quality.<name>.<measure>``, told by the action that runs over it anyway."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def watch(self, df: DataFrame, name: str, text_col: str = "text") -> tuple[DataFrame, Callable[[], dict[str, float]]]:
        """``df`` to be used instead, and what records its measures once an action has run."""
        t = F.col(text_col)
        out, told = observed(df, f"quality-{name}", documents=F.count(F.lit(1)), missing=F.count_if(t.isNull()), blank=F.count_if(F.trim(t) == ""), chars=F.coalesce(F.sum(F.length(t)), F.lit(0)))

        def record() -> dict[str, float]:
            got = told.get
            n = max(got["documents"], 1)
            measures = {"documents": got["documents"], "missing_share": got["missing"] / n, "blank_share": got["blank"] / n, "mean_chars": got["chars"] / n}
            for m, v in measures.items():
                self.metrics.record(f"quality.{name}.{m}", v)
            return measures

        return out, record


def dashboard(metrics: Metrics, seconds: float = 300, now: float | None = None) -> dict[str, dict]:
    """Latest, mean and number of values of the last minutes, by kind of metric: system, operation, quality, other."""
    since = (time.time() if now is None else now) - seconds
    out: dict[str, dict] = {"system": {}, "operation": {}, "quality": {}, "other": {}}
    for n in metrics.names():
        values = [v for at, v, _ in metrics.series(n) if at >= since]
        if values:
            kind = n.split(".", 1)[0]
            out[kind if kind in out else "other"][n] = {"latest": values[-1], "mean": sum(values) / len(values), "values": len(values)}
    return out


class Monitoring:
    """All of it together: metrics, the machine, alerts with the default rules, quality and the dashboard."""

    def __init__(self, interval: float = 5.0, rules: Sequence[Rule] = DEFAULT_RULES):
        self.metrics = Metrics()
        self.system = SystemMonitor(self.metrics, interval)
        self.alerts = Alerts(self.metrics, rules)
        self.quality = QualityMonitor(self.metrics)

    def __enter__(self) -> Monitoring:
        self.system.sample()
        self.system.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.system.stop()

    def report(self, path: str | None = None) -> dict:
        """The dashboard and the alerts that are met; as a JSON file too where a path is given."""
        out = {"metrics": dashboard(self.metrics), "alerts": self.alerts.check()}
        if path:
            with open(path, "w", encoding="utf-8") as f:  # on the driver's machine, like the log
                json.dump(out, f)
        return out


class JsonFormatter(logging.Formatter):
    """A record a line."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"at": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if getattr(record, "context", None):
            out["context"] = record.context
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)


def setup_logging(path: str | None = None, level: int = logging.INFO, as_json: bool = True) -> logging.Logger:
    from logging.handlers import RotatingFileHandler

    handler = RotatingFileHandler(path, maxBytes=10_000_000, backupCount=5, encoding="utf-8") if path else logging.StreamHandler()
    handler.setFormatter(JsonFormatter() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(level)
    return log


class ContextFilter(logging.Filter):
    """Adds fields to every record, such as the run or the stage."""

    def __init__(self, **fields: object):
        super().__init__()
        self.fields = fields

    def filter(self, record: logging.LogRecord) -> bool:
        record.context = {**getattr(record, "context", {}), **self.fields}
        return True


class ProgressFilter(logging.Filter):
    """Lets records with ``extra={"progress": ...}`` through once in ``seconds``; all others pass."""

    def __init__(self, seconds: float = 1.0):
        super().__init__()
        self.seconds, self._last = seconds, float("-inf")

    def filter(self, record: logging.LogRecord) -> bool:
        if not hasattr(record, "progress"):
            return True
        now = time.monotonic()
        if now - self._last < self.seconds:
            return False
        self._last = now
        return True


@contextmanager
def timed_block(what: str, logger: logging.Logger = log, level: int = logging.INFO) -> Iterator[None]:
    """Logs how long a block took, and its error where it fails."""
    start = time.perf_counter()
    try:
        yield
    except BaseException:
        logger.exception("%s failed after %.3f s", what, time.perf_counter() - start)
        raise
    logger.log(level, "%s took %.3f s", what, time.perf_counter() - start)


def timed(f: Callable) -> Callable:
    """A function whose calls are timed in the log."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        with timed_block(f.__name__):
            return f(*args, **kwargs)

    return run


def logged(f: Callable) -> Callable:
    """A function whose calls, with the types of what they take and give, are logged."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        log.debug("%s(%s)", f.__name__, ", ".join([*(type(a).__name__ for a in args), *(f"{k}: {type(v).__name__}" for k, v in kwargs.items())]))
        out = f(*args, **kwargs)
        log.debug("%s gave %s", f.__name__, type(out).__name__)
        return out

    return run
