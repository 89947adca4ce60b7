"""Agreement of raters, all from item-by-value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fleiss_kappa(votes: DataFrame, item: str, value: str, raters: int) -> DataFrame:
    """Items with exactly that many votes."""
    cell = votes.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count(F.lit(1)).alias("n"))
    full = cell.groupBy(item).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("sq")).where(F.col("total") == raters)
    agree = full.agg(F.avg((F.col("sq") - raters) / (raters * (raters - 1.0))).alias("p"), F.count(F.lit(1)).alias("items"))
    share = cell.join(full.select(item), item, "left_semi").groupBy(value).agg(F.sum("n").alias("n"))
    chance = share.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe"))
    return agree.join(F.broadcast(chance)).select("items", F.round((F.col("p") - F.col("pe")) / (1 - F.col("pe")), 6).alias("kappa"))


def krippendorff_alpha(votes: DataFrame, item: str, value: str) -> DataFrame:
    """Nominal alpha; missing votes are left out, items with one vote don't count."""
    cell = votes.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count(F.lit(1)).alias("n"))
    size = cell.groupBy(item).agg(F.sum("n").alias("m")).where("m > 1")
    used = cell.join(size, item)
    seen = used.groupBy(item, "m").agg(F.sum(F.col("n") * F.col("n")).alias("sq")).agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1.0)).alias("do"), F.sum("m").alias("n"))
    share = used.groupBy(value).agg(F.sum("n").alias("n")).agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs"))
    return seen.join(F.broadcast(share)).select(F.col("n").alias("votes"), F.round(1 - F.col("do") * (F.col("n") - 1) / F.col("pairs"), 6).alias("alpha"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two raters; rows where either is missing are left out."""
    cell = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cell.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("x")), cell.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("y"))
    pe = rows.join(cols, "v").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    total = cell.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    po, e = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return total.join(F.broadcast(pe)).select("n", F.round((po - e) / (1 - e), 6).alias("kappa"))
