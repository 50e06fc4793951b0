import pytest
from pyspark.sql import functions as F

from textquarry.functions.identity import account_key, page_key


@pytest.mark.parametrize(("a", "b"), [("Ann_1", "@ann_1 "), ("u/Ann_1", "/u/ann_1"), ("ann_1\xa0", "ANN_1")])
def test_account_key(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(account_key(F.col("a")), account_key(F.col("b"))).first()
    assert r[0] == r[1] == "ann_1"


@pytest.mark.parametrize("x", [None, "", "  ", "-", "N/A", "[deleted]", "Anonymous"])
def test_stand_ins_are_no_key(spark, x):
    r = spark.createDataFrame([(x,)], "x string").select(account_key(F.col("x")), page_key(F.col("x"))).first()
    assert r[0] is None and r[1] is None


def test_page_key(spark):
    same = ["https://board.example/t/1", "HTTP://www.Board.example/t/1/", "board.example/t/1#c2", "https://board.example:443/t/1?utm_source=feed"]
    other = ["https://board.example/t/2", "https://board.example/t/1?page=2", "https://boards.example/t/1"]
    df = spark.createDataFrame([(x,) for x in same + other], "x string").select(page_key(F.col("x")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert len(set(keys[:4])) == 1 and len(set(keys)) == 4
    assert spark.createDataFrame([("a.example/v?b=2&a=1",)], "x string").select(page_key(F.col("x"))).first()[0] == "a.example/v?a=1&b=2"
