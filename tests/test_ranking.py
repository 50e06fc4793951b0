from pyspark.sql import functions as F

from textquarry.operators.ranking import seeded_rank


def test_ranks_are_whole_and_repeat(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 < 4, F.lit("big")).alias("k"))
    got = {r.id: (r.k, r._rank) for r in seeded_rank(df, ["k"], "id", 7).collect()}
    assert len(got) == 500
    for k, n in (("big", 400), (None, 100)):
        assert sorted(rank for key, rank in got.values() if key == k) == list(range(1, n + 1))
    again = {r.id: (r.k, r._rank) for r in seeded_rank(df.repartition(7), ["k"], "id", 7).collect()}
    assert again == got
    assert seeded_rank(df.limit(0), ["k"], "id", 7).count() == 0
    assert seeded_rank(df.union(df), ["k"], "id", 7).count() == 1000
