"""Draws with quotas, floors and limits. Order is by md5 of a seed and the key, so every engine draws alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.operators.sample import dice


def ranked(df: DataFrame, by: Sequence[str], key: str, seed: str, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(dice(key, seed), key)))


def best_first_rounds(df: DataFrame, group: str, key: str, rank: Column, n: int, seed: str) -> DataFrame:
    """Round robin over groups: in each round every group gives its best row left; groups with better rows come first."""
    first = df.withColumn("_r", rank).withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy("_r", dice(key, seed), key)))
    order = first.withColumn("_best", F.min("_r").over(Window.partitionBy(group)))
    return order.orderBy("turn", "_best", group).limit(n).select(group, key, "turn")


def limited(df: DataFrame, bucket: str, profile: str, key: str, each: int, cap: int, seed: str) -> DataFrame:
    """At most `each` rows of a profile in a bucket, and `cap` rows of a bucket."""
    few = ranked(df, [bucket, profile], key, seed, "_p").where(F.col("_p") <= each)
    return few.withColumn("_b", F.row_number().over(Window.partitionBy(bucket).orderBy("_p", dice(key, seed), key))).where(F.col("_b") <= cap).drop("_p", "_b")


def stratified(df: DataFrame, strata: Sequence[str], spread: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows with the strata's shares (largest remainder), each stratum's rows spread over the values of a column."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    exact = counts.join(F.broadcast(total)).withColumn("_x", F.round(F.col("_n") * n / F.col("_all"), 9))
    # As many rows as there are strata.
    w = Window.orderBy(F.desc(F.round(F.col("_x") - F.floor("_x"), 9)), *strata)
    rest = exact.withColumn("_rest", n - F.sum(F.floor("_x")).over(Window.partitionBy())).withColumn("_k", F.row_number().over(w))
    quota = rest.select(*strata, F.least(F.col("_n"), F.floor("_x") + F.when(F.col("_k") <= F.col("_rest"), 1).otherwise(0)).alias("_q"))
    turns = ranked(df, [*strata, spread], key, seed, "_t").join(quota, [*strata])
    order = Window.partitionBy(*strata).orderBy("_t", spread)
    return turns.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= F.col("_q")).drop("_t", "_q", "_o")


def floored(df: DataFrame, key: str, flags: Mapping[str, Column], floor: int, n: int, seed: str) -> DataFrame:
    """n rows by lot, of which at least `floor` have each flag (where there are so many): those come first, then the rest."""
    rows = df.select("*", *(c.alias(f"_{k}") for k, c in flags.items()))
    for k in flags:
        w = Window.partitionBy(f"_{k}").orderBy(dice(key, seed), key)
        rows = rows.withColumn(f"_rank_{k}", F.when(F.col(f"_{k}"), F.row_number().over(w)))
    forced = F.greatest(*(F.coalesce(F.col(f"_rank_{k}") <= floor, F.lit(False)) for k in flags)) if len(flags) > 1 else F.coalesce(F.col(f"_rank_{next(iter(flags))}") <= floor, F.lit(False))
    return rows.withColumn("forced", forced).orderBy(F.desc("forced"), dice(key, seed), key).limit(n).select(*df.columns, "forced")


def blocks(df: DataFrame, by: str, key: str, calibration: int, seed: str) -> DataFrame:
    """`block`: calibration for the first rows of each group by lot, main for the others."""
    return ranked(df, [by], key, seed).withColumn("block", F.when(F.col("rn") <= calibration, "calibration").otherwise("main")).drop("rn")


def unknown_pairs(known: DataFrame, a: str, b: str, least: int, n: int, seed: str) -> DataFrame:
    """The first n pairs of well covered items (in at least `least` known pairs) that are not known, in the order of the
    items' lots (of the later item, then of the earlier). Only as many items are paired as it takes to find n."""
    both = known.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct()
    ends = both.select(F.col("lo").alias("x")).unionByName(both.select(F.col("hi").alias("x")))
    covered = ends.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("x", dice("x", seed).alias("l"))
    total, items = covered.count(), 8 + 2 * int((2 * n) ** 0.5)
    while True:
        # `items` rows, whatever the table's size, unless nearly all pairs are known.
        numbered = covered.orderBy("l", "x").limit(items).withColumn("i", F.row_number().over(Window.orderBy("l", "x")))
        l, r = numbered.alias("l"), numbered.alias("r")
        pairs = l.join(r, F.col("l.i") < F.col("r.i")).select(F.least("l.x", "r.x").alias("lo"), F.greatest("l.x", "r.x").alias("hi"), F.col("l.i").alias("i"), F.col("r.i").alias("j"))
        found = pairs.join(both, ["lo", "hi"], "left_anti")
        if items >= total or found.limit(n).count() >= n:
            return found.orderBy("j", "i").limit(n).select("lo", "hi")
        items *= 2


def topped_up(kept: DataFrame, pool: DataFrame, key: str, safe: str, share: float, variance: str, seed: str) -> DataFrame:
    """kept with safe rows of the pool until they are `share` of all: those of most variance first, then by lot."""
    counts = kept.agg(F.count(F.lit(1)).alias("_n"), F.count_if(safe).alias("_s"))
    need = F.ceil((share * F.col("_n") - F.col("_s")) / (1 - share))
    more = pool.where(F.col(safe)).join(kept.select(key), key, "left_anti").withColumn("_o", F.row_number().over(Window.orderBy(F.desc(variance), dice(key, seed), key)))
    chosen = more.join(F.broadcast(counts)).where(F.col("_o") <= need).select(*pool.columns)
    return kept.withColumn("added", F.lit(False)).unionByName(chosen.withColumn("added", F.lit(True)))


def first_list(c: Column, lists: Mapping[str, Sequence[str]], last: str) -> Column:
    """The first list one of whose names a text holds: the old split, which leaks where a text names drugs of several
    lists (`leaky`: how many it does); kept to show that."""
    hit = {k: F.greatest(*(c.contains(x) for x in v)) if len(v) > 1 else c.contains(v[0]) for k, v in lists.items()}
    out = F.lit(last)
    for k in reversed(list(lists)):
        out = F.when(hit[k], k).otherwise(out)
    return F.struct(out.alias("part"), sum((h.cast("int") for h in hit.values()), F.lit(0)).alias("n_lists"))
