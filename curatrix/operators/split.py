"""Group-disjoint splits and coupled caps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.sample import dice, split


def components(edges: DataFrame) -> DataFrame:
    """v, c: least vertex of each vertex's component, by contraction; every round is checkpointed by a table write or,
    without a checkpoint folder, kept by cache."""
    spark = edges.sparkSession
    live = edges.select("a", "b").where("a <> b").distinct()
    label = live.select(F.col("a").alias("v")).union(live.select("b")).distinct().select("v", F.col("v").alias("c"))
    durable = spark.sparkContext.getCheckpointDir() is not None

    def keep(df: DataFrame) -> DataFrame:
        return df.checkpoint() if durable else df.cache()

    live = keep(live)
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = keep(hook.join(up, "p", "left").select("v", F.least("p", F.coalesce("pp", "p")).alias("p")))
        label = keep(label.join(step.select(F.col("v").alias("c"), "p"), "c", "left").select("v", F.coalesce("p", "c").alias("c")))
        a, b = (step.select(F.col("v").alias(k), F.col("p").alias(f"n{k}")) for k in "ab")
        live = keep(live.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).where("a <> b").distinct())
    return label


def disjoint(edges: DataFrame, seed: str) -> DataFrame:
    """v, c and part: every component goes to one part by the hash of its least vertex."""
    return components(edges).withColumn("part", split("c", seed))


def greedy_caps(df: DataFrame, key: str, tags: str, cap: int, seed: str) -> DataFrame:
    """Rows kept in hash order while one of their tags has room.

    Only rows that could be kept reach the sequential step: a row that isn't among the first `cap` of any of its tags,
    counted over all rows of the tag, may still be kept late, so none is dropped before; the step streams the rows in
    order with a counter for each tag and holds no rows.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[str, int] = {}
        for frame in it:
            keep = []
            for some in frame[tags]:
                ok = any(used.get(x, 0) < cap for x in some)
                keep.append(ok)
                if ok:
                    for x in some:
                        used[x] = used.get(x, 0) + 1
            yield frame[keep][[key]]

    ordered = df.where(F.size(tags) > 0).select(key, tags, dice(key, seed).alias("_o")).repartition(1).sortWithinPartitions("_o", key)
    return ordered.mapInPandas(run, f"{key} long")
