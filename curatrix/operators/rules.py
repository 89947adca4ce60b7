"""Validation rules compiled into one projection: each row gets an array of issues, which is then exploded."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    check: str
    severity: str
    broken: Column
    detail: Column


class Each(NamedTuple):
    """A rule that a row can break several times: an issue for each of the details (array of strings)."""

    check: str
    severity: str
    details: Column


def issues(df: DataFrame, key: str, rules: Sequence[Rule | Each]) -> DataFrame:
    """key, check_name, severity, detail: a row for each rule that a row breaks. One scan, no shuffle."""
    one = lambda r, detail: F.struct(F.lit(r.check).alias("check_name"), F.lit(r.severity).alias("severity"), detail.cast("string").alias("detail"))
    none = F.array().cast("array<struct<check_name:string,severity:string,detail:string>>")
    each = lambda r: F.coalesce(F.transform(r.details, lambda d: one(r, d)), none)
    made = [each(r) if isinstance(r, Each) else F.when(r.broken, F.array(one(r, r.detail))).otherwise(none) for r in rules]
    return df.select(F.col(key), F.explode(F.flatten(F.array(*made))).alias("i")).select(key, "i.*")


def rollup(found: DataFrame, severities: Sequence[str] = ("error", "warning")) -> DataFrame:
    return found.groupBy("check_name").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in severities))


def id_issues(df: DataFrame, key: str) -> DataFrame:
    """One row of counts: missing, repeated and absent ids of a run 0 .. max (no list of ids is made)."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("n_repeated"), (F.max(key) + 1 - F.count(key)).alias("n_absent"))


def gaps(df: DataFrame, key: str, first: int) -> DataFrame:
    """The first absent ids: neighbours in order whose difference is more than one. Dealt by ranges of the key."""
    from pyspark.sql.window import Window

    near = df.select(key).distinct().withColumn("_part", F.floor(F.col(key) / 10_000))
    edge = near.groupBy("_part").agg(F.min(key).alias(key)).select(F.col(key), (F.col("_part") - 1).alias("_part"))
    both = near.unionByName(edge.where("_part >= 0"))
    w = Window.partitionBy("_part").orderBy(key)
    return both.withColumn("next_id", F.lead(key).over(w)).where(F.col("next_id") - F.col(key) > 1).select((F.col(key) + 1).alias("gap_from"), (F.col("next_id") - 1).alias("gap_to")).orderBy("gap_from").limit(first)
