"""The split search on more groups than a few hundred."""

from pyspark.sql import functions as F

from curatrix.operators import search


def test_all_groups_can_move(spark):
    """From 2,000 equal groups in train, a quarter has to move."""
    stats = spark.range(2000).select(F.col("id").alias("g"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("unsafe"), F.array(F.lit(1).cast("long")).alias("pos"))
    at = search.improve(stats, stats.select("g", F.lit(0).alias("part")), "g")
    n = {r["part"]: r["count"] for r in at.groupBy("part").count().collect()}
    assert sum(n.values()) == 2000 and abs(n[0] - 1500) <= 10 and abs(n[1] - 200) <= 10
