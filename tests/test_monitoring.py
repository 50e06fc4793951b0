import json
import logging
import os

from pyspark.sql import functions as F

from textquarry.streaming import monitoring as M


def test_statistics(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3, 4)], "name string, s int, value double").select("name", F.timestamp_seconds("s").alias("ts"), "value")
    r = M.metric_statistics(df).first()
    assert (r["count"], r.min, r.max, r.mean, r.latest, r.median) == (4, 1, 4, 2.5, 4, 2.5)
    assert M.metric_statistics(df, since=F.timestamp_seconds(F.lit(3))).first()["count"] == 2
    assert M.metric_statistics(df.limit(0)).count() == 0
    fired = M.alerts(M.metric_statistics(df), [M.Rule("hi", "a", "gt", 3), M.Rule("lo", "a", "lt", 3), M.Rule("eq", "a", "eq", 4)])
    assert {x.rule for x in fired.collect()} == {"hi", "eq"}


def test_windows_and_sessions(spark):
    df = spark.createDataFrame([("u", 0), ("u", 60), ("u", 7200)], "u string, s int").select("u", F.timestamp_seconds("s").alias("ts"), F.lit(1.0).alias("value"))
    assert sorted(r["count"] for r in M.windowed(df, "10 minutes", name_col="u").collect()) == [1, 2]
    assert sorted(r.events for r in M.sessions(df, "u").collect()) == [1, 2]


def test_late_rows_end_with_the_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, s in enumerate((0, 3600, 3700, 10, 7200)):  # rows are late by the watermark of the batch before theirs
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"s": s}))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of these times
    stream = spark.readStream.schema("s int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).select(F.timestamp_seconds("s").alias("ts"), F.lit("m").alias("name"), F.lit(1.0).alias("value"))
    w = M.windowed(stream, "1 minute", watermark="5 minutes")
    q = w.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start.timestamp(), r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("start"), "count").collect()) == [(0, 1), (3600, 1), (3660, 1)]


def test_collector(spark, tmp_path):
    m = M.Metrics(history=2)
    for v in (1, 2, 3):
        m.record("x", v, {"k": "v"})
    assert [v for _, v, _ in m.series("x")] == [2, 3] and m.table(spark).count() == 2
    with m.operation("work", 10):
        pass
    try:
        with m.operation("bad"):
            raise KeyError
    except KeyError:
        pass
    assert m.series("operation.bad.ok")[0][1] == 0 and m.series("operation.work.throughput")
    a = M.Alerts(m, [M.Rule("r", "x", "gt", 2)])
    seen = []
    a.handlers += [lambda f: 1 / 0, seen.append]
    assert a.check()[0]["value"] == 3 and len(seen) == 1
    m.export(str(tmp_path / "m.json"))
    assert "x" in json.load(open(tmp_path / "m.json"))
    M.SystemMonitor(m).sample()
    m.clear()
    assert m.names() == []


def test_observed(spark):
    df, o = M.observed(spark.range(5), "rows", n=F.count("*"))
    df.collect()
    assert o.get["n"] == 5


def test_logging(tmp_path):
    log = M.setup_logging(str(tmp_path / "l.log"))
    log.info("hello")
    for h in log.handlers:
        h.flush()
    assert json.loads((tmp_path / "l.log").read_text())["message"] == "hello"
    log.handlers[:] = [logging.NullHandler()]


def test_all_together(spark, tmp_path):
    with M.Monitoring(interval=0.05, rules=[*M.DEFAULT_RULES, M.Rule("much missing", "quality.docs.missing_share", "gt", 0.3)]) as m:
        df, record = m.quality.watch(spark.createDataFrame([("ab",), (" ",), (None,), (None,)], "text string"), "docs")
        df.count()
        df.write.format("noop").mode("overwrite").save()
        assert record() == {"documents": 4, "missing_share": 0.5, "blank_share": 0.25, "mean_chars": 0.75}
        with m.metrics.operation("work"):
            pass
        m.metrics.record("own", 1, at=0)
        out = m.report(str(tmp_path / "r.json"))
    assert [a["rule"] for a in out["alerts"] if a["rule"] == "much missing"] and json.loads((tmp_path / "r.json").read_text()) == out
    assert out["metrics"]["quality"]["quality.docs.documents"] == {"latest": 4.0, "mean": 4.0, "values": 1} and "operation.work.ok" in out["metrics"]["operation"] and not out["metrics"]["other"]


def test_log_filters_and_decorators(tmp_path):
    path = tmp_path / "log"
    log = M.setup_logging(str(path), logging.DEBUG)
    handler = log.handlers[0]
    handler.addFilter(M.ContextFilter(run="r1"))
    handler.addFilter(M.ProgressFilter(60))
    for i in range(3):
        log.info("step %d", i, extra={"progress": i})
    log.info("plain")

    @M.timed
    @M.logged
    def work(x, k=1):
        if x is None:
            raise ValueError(x)
        return x

    assert work(2, k=3) == 2 and work.__name__ == "work"
    try:
        work(None)
    except ValueError:
        pass
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    log.handlers.clear()
    assert [x["message"] for x in lines][:4] == ["step 0", "plain", "work(int, k: int)", "work gave int"] and all(x["context"] == {"run": "r1"} for x in lines)
    assert lines[4]["message"].startswith("work took") and lines[-1]["message"].startswith("work failed") and "ValueError" in lines[-1]["error"]
