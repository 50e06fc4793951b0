import json

import pytest

from textquarry.plans.cli import main
from textquarry.plans.config import Config
from textquarry.plans.pipeline import Pipeline
from textquarry.plans.versioning import DatasetTracker, Stages, fingerprint


def test_config(tmp_path, monkeypatch):
    c = Config({"ingestion": {"sources": [{"type": "file", "path": "x"}]}, "output": {"compression": "gzip"}})
    assert c.problems() == [] and c.get("output.format") == "parquet" and c.get("a.b", 3) == 3
    c.save(str(tmp_path / "c.yaml"))
    assert Config.load(str(tmp_path / "c.yaml")).tree == c.tree
    monkeypatch.setenv("TEXTQUARRY__QUALITY__MIN_QUALITY_SCORE", "0.4")
    c.from_environment()
    assert c.section("quality").min_quality_score == 0.4
    assert len(Config({"output": {"splits": {"a": 0.5}, "zz": 1}, "project": {"name": ""}}).problems()) == 4
    with pytest.raises(ValueError):
        Config.load("x.ini")


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    b = spark.createDataFrame([(None, 2), ("x", 1)], "t string, i int").repartition(2)
    assert fingerprint(a) == fingerprint(b)
    assert fingerprint(a) != fingerprint(a.union(a)) != fingerprint(a.limit(0))


def test_versions(spark, tmp_path):
    t = DatasetTracker(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    v1 = t.create(a, "base", tags=["raw"])
    assert t.create(a) == v1
    assert not t.delete(v1)
    v2 = t.create(a.union(a).drop("t"), tags=["small"])
    assert t.compare(v1, v2) == {"identical": False, "document_difference": 1, "new_fields": [], "removed_fields": ["t"]}
    b = t.branch(v1, "side")
    assert t.compare(v1, b, rows=True)["only_in_first"] == 0
    assert [v.version_id for v in t.list(["small"])] == [v2]
    assert t.load(b).count() == 1 and t.delete(v1) and t.load(b).count() == 1
    again = DatasetTracker(spark, str(tmp_path))
    assert set(again.versions) == {v2, b} and again.summary()["versions"] == 2
    assert len(again.cleanup(1)) == 1


def test_stages_resume_and_errors(spark, tmp_path):
    runs = []

    def first(_):
        runs.append("first")
        return spark.range(3)

    def fails(df):
        runs.append("second")
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        Stages(spark, str(tmp_path), "k").run({"first": first, "second": fails})
    s = Stages(spark, str(tmp_path), "k")
    assert s.status() == {"first": "done", "second": "error"}
    assert s.run({"first": first, "second": lambda df: df.limit(2)}).count() == 2 and runs.count("first") == 1
    assert Stages(spark, str(tmp_path), "other").run({"first": first}).count() == 3
    assert Stages(spark, str(tmp_path), "other").cleanup(1)


def test_pipeline_and_cli(spark, tmp_path, capsys):
    lines = [json.dumps({"text": f"<p>Document number {i} has   some words, and a few more of them.</p>", "lang": "en"}) for i in range(30)]
    (tmp_path / "in.jsonl").write_text("\n".join([*lines, lines[0], json.dumps({"no": 1})]), encoding="utf-8")
    config = Config(
        {
            "project": {"output_dir": str(tmp_path / "out")},
            "ingestion": {"sources": [{"type": "file", "path": str(tmp_path / "in.jsonl")}]},
            "preprocessing": {"dedup": {"methods": ["exact", "content"], "content": {"max_common_ratio": 0.99}}, "tokenizer": {"type": "simple"}},
            "quality": {"filters": [{"type": "length", "min_length": 5}, {"type": "toxicity"}, {"type": "quality", "min_score": 0.1}]},
            "augmentation": {"enabled": True, "techniques": ["back_translation", "synthetic"], "variations": 1, "synthetic": 10},
        }
    )
    got = Pipeline(spark, config).run()
    assert sum(got["splits"].values()) == 30 + 15 + 10 and got["dropped"]["no_text"] == 1
    assert Pipeline(spark, config).run()["version"] == got["version"]
    with pytest.raises(ValueError):
        Pipeline(spark, Config())
    config.save(str(tmp_path / "c.json"))
    assert main(["config", "validate", str(tmp_path / "c.json")]) == 0
    assert main(["clean", str(tmp_path / "in.jsonl"), str(tmp_path / "clean"), "--min-length", "5"], spark) == 0
    assert spark.read.json(str(tmp_path / "clean")).count() == 31
    assert main(["assess", str(tmp_path / "in.jsonl"), "--report", str(tmp_path / "r.html"), "--format", "html"], spark) == 0
    assert main(["augment", str(tmp_path / "in.jsonl"), str(tmp_path / "aug")], spark) == 0
    assert main(["dataset", "list-versions", str(tmp_path / "out" / "versions")], spark) == 0
    assert got["version"] in capsys.readouterr().out
