"""Column profiles, pivots with totals, modal values and independence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def columns(df: DataFrame, names: Sequence[str], null_words: Sequence[str] = ("",)) -> DataFrame:
    """n, missing, distinct and ratio of each column: one unpivot, then one aggregation by (column, value)."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in names))).alias("x")).select("x.*")
    values = long.withColumn("v", F.when(~F.trim("v").isin(list(null_words)), F.col("v"))).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("column_name").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.count("v").alias("n_distinct")).withColumn("distinct_ratio", F.round(F.col("n_distinct") / F.greatest(F.col("n") - F.col("n_missing"), F.lit(1)), 6))


def entropy(df: DataFrame, of: Column, *by: str) -> DataFrame:
    """Normalised Shannon entropy of the values; 0 for one value."""
    counts = df.groupBy(*by, of.alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # H = log2(N) - sum(n log2 n) / N: additive, no window is needed.
    agg = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.count(F.lit(1)).alias("k"))
    h = (F.log2("total") - F.col("nlogn") / F.col("total")) / F.log2("k")
    return agg.select(*by, F.col("k").alias("n_values"), F.when(F.col("k") > 1, F.round(h, 6)).otherwise(0.0).alias("entropy"))


def patterns(df: DataFrame, signature: Column) -> DataFrame:
    w = Window.partitionBy()
    return df.groupBy(signature.alias("signature")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def matrix(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row x column with a total, and a TOTAL row; values are fixed, so the pivot needs no extra pass."""
    names = [F.count_if(F.col(column) == v).alias(v.lower().replace("-", "_").replace(" ", "_")) for v in values]
    return df.rollup(row).agg(*names, F.count(F.lit(1)).alias("total")).withColumn(row, F.when(F.col(row).isNull(), "TOTAL").otherwise(F.col(row).cast("string")))


def modal(df: DataFrame, key: str, value: str, fallback: str) -> DataFrame:
    """The most frequent value of each key (ties: the smallest), else the fallback's most frequent value; with its share."""
    one = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("best"), F.sum("n").alias("total"))
    all_ = df.groupBy(fallback).agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(fallback).alias("v"))).alias("top"))
    return one.join(F.broadcast(all_)).select(key, F.coalesce("best.v", "top.v").alias("modal"), F.round(-F.col("best.m") / F.col("total"), 6).alias("share"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom; expected counts from the margins (small tables)."""
    cell = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = cell.groupBy(a).agg(F.sum("n").alias("r")), cell.groupBy(b).agg(F.sum("n").alias("c"))
    total = cell.agg(F.sum("n").alias("t"))
    grid = rows.join(F.broadcast(cols)).join(F.broadcast(total)).join(cell, [a, b], "left")
    e = F.col("r") * F.col("c") / F.col("t")
    return grid.agg(F.round(F.sum(F.pow(F.coalesce("n", F.lit(0.0)) - e, F.lit(2)) / e), 4).alias("chi_square"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"))


def numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """column_name, lo, hi, mean, mid and sd of numeric columns, in one aggregation."""
    one = lambda c: F.struct(F.lit(c).alias("column_name"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.round(F.avg(c), 4).alias("mean"), F.median(c).cast("double").alias("mid"), F.round(F.stddev_samp(c), 4).alias("sd"))
    return df.agg(F.array(*map(one, names)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
