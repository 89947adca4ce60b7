"""Bootstrap by hashed draws: resample b takes row number md5(seed:b:i) mod n for i in 0 .. n - 1.

Draws are counted for each row before they meet the data, so what is joined has one row for each (resample, drawn row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def draws(spark: SparkSession, n: int, resamples: int, seed: str) -> DataFrame:
    """b, i, times."""
    grid = spark.range(n * resamples).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("k"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("b").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long") % n
    return grid.select("b", at.alias("i")).groupBy("b", "i").agg(F.count(F.lit(1)).alias("times"))


def mean_ci(rows: DataFrame, n: int, value: str, resamples: int, seed: str) -> DataFrame:
    """rows: i (0 .. n - 1) and value. Percentile interval (linear) of the mean."""
    drawn = draws(rows.sparkSession, n, resamples, seed).join(rows, "i").groupBy("b").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m"))
    return drawn.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.count(F.lit(1)).alias("resamples"))


def paired_delta(rows: DataFrame, n: int, a: str, b: str, resamples: int, seed: str) -> DataFrame:
    """Interval of mean(a) - mean(b) with the same draws for both, and the share of resamples in which it is positive."""
    drawn = draws(rows.sparkSession, n, resamples, seed).join(rows, "i").groupBy("b").agg((F.sum((F.col(a) - F.col(b)) * F.col("times")) / F.sum("times")).alias("d"))
    return drawn.agg(F.round(F.percentile("d", 0.025), 6).alias("low"), F.round(F.percentile("d", 0.975), 6).alias("high"), F.round(F.avg((F.col("d") > 0).cast("double")), 6).alias("p_positive"))
