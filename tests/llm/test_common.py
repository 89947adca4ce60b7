"""The shared helpers: least ranks of groups, joins with frequent keys, components."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from curatrix.llm import common


def test_least_takes_the_least_ranks_of_each_group(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 30, "b").otherwise("c").alias("g"), F.xxhash64("id").alias("h"))
    held = defaultdict(list)
    for r in rows.collect():
        held[r.g].append((r.h, r.id))
    for n in (1, 50, 100_000):
        got = defaultdict(list)
        for r in common.least(rows, "g", "h", n).collect():
            got[r.g].append((r.h, r.id))
        assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x)[:n] for g, x in held.items()}
    assert common.least(rows.limit(0), "g", "h", 5).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    assert Counter(map(tuple, common.components(edges).select("v", "c").collect())) == Counter([("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")])


def test_join_counted_is_the_plain_join(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 700).alias("k"))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    want = Counter(map(tuple, rows.join(counted, ["k"]).select("k", "id", "n").collect()))
    for often, most in ((1, 10_000), (4, 10_000), (10**6, 10_000), (1, 2)):
        assert Counter(map(tuple, common.join_counted(rows, counted, ["k"], often, most).select("k", "id", "n").collect())) == want
    assert common.join_counted(rows, counted.limit(0), ["k"], 1).count() == 0
