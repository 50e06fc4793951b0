from textquarry.sources.storage import Storage, join, plain


def test_small_files(spark, tmp_path):
    s, d = Storage(spark), str(tmp_path / "a b")
    assert not s.exists(d) and s.files(d) == [] and not s.is_folder(d)
    s.make_folder(d)
    path = join(d, "x.json")
    for text in ("first", "sécond ф", ""):
        s.write(path, text)
        assert s.read(path) == text and open(path, encoding="utf-8").read() == text
    s.write(join(d, "sub", "y.txt"), "1")
    assert [(f.path, f.size) for f in s.files(d)] == [(join(d, "sub", "y.txt"), 1), (path, 0)] and [f.path for f in s.files(d, recursive=False)] == [path]
    assert [f.path for f in s.files(path)] == [path] and s.is_folder(d) and not s.is_folder(path)
    s.write("file://" + path, "again")
    assert s.read(path) == "again" and plain("file:///x/y") == "/x/y" and plain("hdfs://h/x") == "hdfs://h/x"
    assert s.delete(d) and not s.exists(path)
