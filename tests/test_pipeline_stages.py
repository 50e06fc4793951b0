"""What the stages of the pipeline report, and that none loses documents unasked."""

import json

from textquarry.plans.config import Config
from textquarry.plans.pipeline import Pipeline


def config(tmp_path, sources, **sections):
    return Config({"project": {"output_dir": str(tmp_path / "out")}, "ingestion": {"sources": sources}, **sections})


def test_quality_is_validated_measured_and_watched(spark, tmp_path):
    lines = [{"text": f"Document number {i} has some words.", "author": "x" if i else None, "more": {"a": i}} for i in range(10)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)), encoding="utf-8")
    alerts = [{"name": "invalid", "metric": "quality.invalid", "operator": "gt", "threshold": 0}, {"metric": "quality.valid", "operator": "gt", "threshold": 100}, {"metric": "none", "operator": "lt", "threshold": 1}]
    own = {"quality": {"required_fields": ["author", "more", "url"]}, "monitoring": {"alerts": alerts}}
    c = config(tmp_path, [{"type": "file", "path": str(tmp_path / "in.jsonl")}], **own)
    got = Pipeline(spark, c).run()
    told = got["quality"]["validation"]
    assert told["documents"] == told["invalid"] == 10 and told["errors"] == {"Missing required field": 10, "Required field is None": 1}
    assert got["quality"]["metrics"]["word_count"] == {"mean": 6.0, "min": 6.0, "max": 6.0} and "lexical_diversity" in got["quality"]["metrics"]
    watched = got["monitoring"]
    assert [a["rule"] for a in watched["alerts"] if a["metric"].startswith("quality")] == ["invalid"] and "none" in watched["not_recorded"]
    assert watched["latest"]["stage.quality.documents"] == 10 and watched["latest"]["stage.quality.duration"] > 0
    assert Pipeline(spark, c).run()["quality"] == got["quality"]
    off = config(tmp_path, c.get("ingestion.sources"), quality={"validate": False}, monitoring={"enabled": False})
    got = Pipeline(spark, off).run()
    assert got["quality"]["validation"] is None and got["monitoring"] is None
    assert config(tmp_path, [{"type": "file"}], monitoring={"alerts": [{"metric": "x", "operator": "ge", "threshold": 1}]}).problems()


def test_ingest_drops_no_copies_and_mixes_no_ids(spark, tmp_path):
    def table(name, *rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name))
        return {"type": "table", "path": str(tmp_path / name)}

    def ingested(*sources, methods=()):
        p = Pipeline(spark, config(tmp_path, list(sources), preprocessing={"dedup": {"methods": list(methods)}}))
        return p.preprocess(p.ingest(None)).collect()

    a, b, c = table("a", (1, "one"), (2, "two")), table("b", (1, "other"), (2, "two")), table("c", (3, "three"))
    (tmp_path / "r.csv").write_text("text\n" + "same row\n" * 5000 + "another row\n", encoding="utf-8")
    csv = {"type": "file", "path": str(tmp_path / "r.csv")}
    assert sorted((r.doc_id, r.text) for r in ingested(a, c)) == [(1, "one"), (2, "two"), (3, "three")]
    both = ingested(a, b)
    assert sorted((r.own_id, r.text) for r in both) == [("1", "one"), ("1", "other"), ("2", "two"), ("2", "two")] and len({r.doc_id for r in both}) == 4
    got = ingested(a, csv)
    assert len(got) == len({r.doc_id for r in got}) == 5003 and {r.doc_id for r in ingested(a, csv)} == {r.doc_id for r in got}
    assert sorted(r.text for r in ingested(csv, methods=["exact"])) == ["another row", "same row"]
    assert len({r.doc_id for r in ingested(csv, csv)}) == 10002
