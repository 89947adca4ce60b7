"""Sampling, caps, quotas and splits. Order is by md5 of a seed and the key, so draws don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dice(key: str, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def top_per_group(df: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(dice(key, seed), key))).where(F.col("rn") <= k)


def spread(df: DataFrame, bucket: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows taken in turn from the buckets."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(dice(key, seed), key)))
    return turn.orderBy("turn", bucket).limit(n)


def quotas(counts: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """Largest remainders: whole shares of `total`, the rest by remainder (ties by group). A row for each group."""
    w = Window.partitionBy()
    exact = counts.withColumn("exact", F.col(size) * total / F.sum(size).over(w)).withColumn("base", F.floor("exact"))
    ranked = exact.withColumn("left", F.lit(total) - F.sum("base").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), group)))
    return ranked.select(group, size, F.least(F.col("base") + (F.col("rank") <= F.col("left")).cast("long"), F.col(size)).alias("quota"))


def balanced(df: DataFrame, group: str, side: Column, key: str, cap: int, seed: str) -> DataFrame:
    """As many rows of either side in each group: the smaller count, at most cap."""
    w = Window.partitionBy(group, "side")
    marked = df.withColumn("side", side).withColumn("rn", F.row_number().over(w.orderBy(dice(key, seed), key)))
    n = marked.groupBy(group).agg(F.count_if("side").alias("yes"), F.count_if(~F.col("side")).alias("no")).select(group, F.least("yes", "no", F.lit(cap)).alias("n"))
    return marked.join(n, group).where("rn <= n")


def oversample(df: DataFrame, key: str, copies: Column) -> DataFrame:
    """Rows repeated; copies after the first get a suffix in `copy_id`."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("copy_id", F.when(F.col("copy") == 0, F.col(key).cast("string")).otherwise(F.concat_ws("_", F.col(key).cast("string"), F.col("copy").cast("string"))))


def derange(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """key and partner: a cyclic shift within the group in random order, so no row of a group of two or more keeps itself."""
    w = Window.partitionBy(group).orderBy(dice(key, seed), key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(group, key, F.coalesce(F.lead(key).over(w), F.first(key).over(whole)).alias("partner"))


def every_kth(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Every k-th row of a group, and always its last."""
    w = Window.partitionBy(group)
    return df.withColumn("rn", F.row_number().over(w.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(w)).where(((F.col("rn") - 1) % k == 0) | (F.col("rn") == F.col("n"))).drop("n")


def split(key: str, seed: str, train: int = 75, validation: int = 10) -> Column:
    """train, validation or test by the hash of a key (percent)."""
    bucket = F.conv(F.substring(dice(key, seed), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")
