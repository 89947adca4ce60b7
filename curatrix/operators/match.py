"""Vocabulary matching and joins by pair, tolerance or prefix."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _word(name: str) -> str:
    return rf"(?i)(^|[^A-Za-z]){re.escape(name)}([^A-Za-z]|$)"


def all_hits(c: Column, names: Sequence[str]) -> Column:
    """Every name that stands in the text as a whole word, in the names' order."""
    return F.array_compact(F.array(*(F.when(c.rlike(_word(n)), F.lit(n)) for n in names)))


def earliest(c: Column, names: Sequence[str]) -> Column:
    """The name that stands first as a whole word; of two at one place the smaller."""
    hits = F.array_compact(F.array(*(F.when(c.rlike(_word(n)), F.struct(F.regexp_instr(c, F.lit(_word(n))).alias("at"), F.lit(n).alias("name"))) for n in names)))
    return F.array_min(hits)["name"]


def first_of(columns: Sequence[Column], names: Sequence[str]) -> Column:
    """The earliest name of the first column that holds one."""
    return F.coalesce(*(earliest(c, names) for c in columns))


def longest(c: Column, names: Sequence[str]) -> Column:
    """The longest name that the lower-case text contains; of equal lengths the smaller."""
    out = F.lit(None).cast("string")
    for n in sorted(names, key=lambda x: (-len(x), x), reverse=True):
        out = F.when(F.lower(c).contains(n.lower()), F.lit(n)).otherwise(out)
    return out


def longest_prefix(words: Column, vocabulary: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The longest run of leading words that is in the vocabulary (column name), for each key."""
    prefixes = F.transform(words, lambda _, i: F.struct((i + 1).alias("_k"), F.array_join(F.slice(words, 1, i + 1), " ").alias("_name")))
    met = df.select(key, F.explode(prefixes).alias("_p")).select(key, "_p._k", "_p._name").join(vocabulary.select(F.col("name").alias("_name")), "_name")
    return met.groupBy(key).agg(F.max_by("_name", "_k").alias("name"))


def worst_pair(df: DataFrame, a: str, b: str, rank: Column) -> DataFrame:
    """Undirected pairs with their highest rank."""
    return df.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.max(rank).alias("worst"))


def tolerance(a: DataFrame, x: str, b: DataFrame, y: str, within: float) -> DataFrame:
    """Rows with |x - y| <= within: an equi-join on buckets of that width, the right side in three of them."""
    left = a.withColumn("_b", F.floor(F.col(x) / within))
    right = b.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(y) / within) + d)))
    return left.join(right, "_b").where(F.abs(F.col(x) - F.col(y)) <= within).drop("_b")
