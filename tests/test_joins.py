from pyspark.sql import functions as F

from textquarry.operators import joins


def test_hot_keys_meet_a_broadcast(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    hot = joins.hot_keys(left, "k")
    assert hot == ["hot"] == joins.hot_counted(right, "k", "n", 3000)
    for how in ("left", "inner"):
        assert sorted(joins.join_unique(left, right, "k", hot, how).collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)
    assert joins.hot_keys(left.limit(0), "k") == []
