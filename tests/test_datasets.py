import json

import pytest

from textquarry.sources import datasets, sinks


def test_datasets_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"one, two"\n2,three\n')
    (tmp_path / "b.csv").write_text("id,text\n3,four\n")
    both = datasets.from_files(spark, {"train": str(tmp_path / "a.csv"), "test": [str(tmp_path / "b.csv")]}, "csv")
    assert sorted((r.id, r.text, r.split) for r in both.collect()) == [(1, "one, two", "train"), (2, "three", "train"), (3, "four", "test")]
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"id": i, "text": f"t{i}"}) for i in range(50)))
    for own in ({"id_col": "id"}, {}):
        drawn = datasets.from_files(spark, str(tmp_path / "c.json"), "json", {"train": 0.8, "test": 0.2}, **own)
        assert drawn.columns == ["id", "text", "split"] and {r.split: r["count"] for r in drawn.groupBy("split").count().collect()} == {"train": 40, "test": 10}
    assert {r.split for r in datasets.from_files(spark, str(tmp_path / "c.json"), "json").collect()} == {"train"}
    with pytest.raises(ValueError):
        datasets.from_files(spark, str(tmp_path), "xls")
    with pytest.raises(FileNotFoundError):
        datasets.load(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("kind", ["parquet", "jsonl", "dataset"])
def test_load_and_stream(spark, tmp_path, kind):
    df = spark.range(30).selectExpr("id", "concat('t', id) as text", "if(id % 5 = 0, 'test', 'train') as split")
    out = str(tmp_path / "d")
    sinks.write_splits(df, out, kind)
    assert sorted(datasets.load(spark, out).select("id", "text", "split").collect()) == sorted(df.collect())
    assert datasets.load(spark, out, "test").count() == 6
    assert (tmp_path / "d" / "dataset_info.json").exists() == (kind == "dataset")
    s = datasets.stream(spark, out, "train", files_a_batch=2)
    assert s.isStreaming
    name = f"rows_{kind}"
    s.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert spark.table(name).count() == 24
