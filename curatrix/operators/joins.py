"""Joins of predictions, replacements and cached context, always by key; what they lose or change is counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _range_of(value: Column, ends: Sequence, first: int = 0) -> Column:
    """How many of the sorted ends lie below a value, by halves."""
    if not ends:
        return F.lit(first)
    m = len(ends) // 2
    return F.when(value > F.lit(ends[m]), _range_of(value, ends[m + 1 :], first + m + 1)).otherwise(_range_of(value, ends[:m], first))


def running(df: DataFrame, order: str, sums: Sequence[str], parts: int, descending: bool = False) -> DataFrame:
    """Adds `upto_<c>` for each of the columns: its sum over all rows up to this one in the order of a column (rows of equal
    order in any order, those without one last). Rows are dealt by ranges and summed there; the ranges' totals, one row each,
    give the starts. The ranges' ends are found first, as two reads of a range shuffle may draw different ones."""
    drawn = df.select(order).where(F.col(order).isNotNull()).repartitionByRange(parts, order).groupBy(F.spark_partition_id()).agg(F.max(order).alias("end"))
    ends = sorted((r.end for r in drawn.collect()), key=lambda x: (x != x, x))[:-1]
    place = _range_of(F.col(order), ends)
    dealt = df.withColumn("_part", F.when(F.col(order).isNull(), parts).otherwise(-place if descending else place))
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    w = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.select("*", *(F.sum(c).over(w).alias(f"_in_{c}") for c in sums))
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_all_{c}") for c in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in sums))
    return inside.join(starts, "_part").select(*df.columns, *((F.col(f"_start_{c}") + F.col(f"_in_{c}")).alias(f"upto_{c}") for c in sums))


def positions(df: DataFrame, order: str, parts: int, name: str = "idx") -> DataFrame:
    """Adds the row's place (from 0) in the order of a column."""
    return running(df.withColumn("one", F.lit(1).cast("long")), order, ["one"], parts).select(*df.columns, (F.col("upto_one") - 1).alias(name))


def in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """One row a group with aggregates that take its rows one after another in the order of some columns.

    Sums of floats depend on the order of their terms in the last digits, and so does what is compared or rounded just there. In
    this order results are the same for any partitions, and those of a database that reads the rows in order with one thread.
    A group streams through one task, as its sum is one chain; nothing of it is collected."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.select(*by, *(c.over(upto).alias(n) for n, c in aggregates.items()), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    return rows.where("_last").drop("_last")


def aligned(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two tables side by side by key: what was once lined up by sorting both, without trusting their order."""
    named = lambda df, s: df.select(key, *(F.col(c).alias(c + s) for c in df.columns if c != key))
    return named(a, suffixes[0]).join(named(b, suffixes[1]), key)


def replaced(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """df with the columns taken from other where it has the key, and one row: n_matched and how many cells changed."""
    new = other.select(key, F.lit(True).alias("_has"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = df.join(new, key, "left")
    swapped = both.select(*(F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))
    changed = [F.count_if(F.col("_has") & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"n_{c}") for c in columns]
    return swapped, both.agg(F.count("_has").alias("n_matched"), *changed)


def with_cached(df: DataFrame, cache: DataFrame, key: str, column: str, blank: str = "") -> DataFrame:
    """df with a cached column; blank where the cache has none."""
    return df.join(cache.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(blank)))


def extracted(df: DataFrame, text: str, pattern: str, value: str) -> tuple[DataFrame, DataFrame]:
    """key (the pattern's group in a text) and value, one row a key, and the keys that have several values."""
    found = df.select(F.regexp_extract(text, pattern, 1).alias("key"), value).where("key <> ''")
    per = found.groupBy("key").agg(F.min(value).alias(value), F.count_distinct(value).alias("n"))
    return per.where("n = 1").select("key", value), per.where("n > 1").select("key", "n")


def checked(df: DataFrame, conflicts: DataFrame) -> DataFrame:
    """df, or an error that names a conflicting key."""
    if bad := conflicts.limit(1).collect():
        raise ValueError(f"several values for the key {bad[0][0]}")
    return df


def pairs_where(df: DataFrame, key: str, equal: Sequence[str], rule) -> DataFrame:
    """a, b of rows that are equal in the given columns and for which rule(left, right) holds: an equi-join, so only rows
    of one group meet. Groups must be small, as all their pairs come out."""
    l, r = df.alias("l"), df.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in equal]
    column = lambda side: lambda c: F.col(f"{side}.{c}")
    met = l.join(r, [*same, F.col(f"l.{key}") < F.col(f"r.{key}")])
    return met.where(rule(column("l"), column("r"))).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), *(F.col(f"l.{c}").alias(c) for c in equal))


def pairs_alike(df: DataFrame, key: str, equal: Sequence[str], same: str, within: Mapping[str, float], rule) -> DataFrame:
    """a, b of rows that are equal in the given columns, and whose column same is equal or for which rule(left, right) holds.

    within: the columns that the rule compares, each with a distance beyond which the rule never holds. Rows are put into
    cells of these widths, and one meets those of its own and of the neighbouring cells, not its whole group: what is
    compared grows with the pairs that come out, in whose number groups of copies are squares."""
    some = df.select(key, *equal, same, *within)
    cell = lambda x, w: F.floor(x / w)
    number = {c: F.col(c).cast("double") for c in within}
    placed = some.select("*", *(cell(number[c], w).alias(f"_at_{c}") for c, w in within.items()))
    around = some
    for c, w in within.items():
        around = around.withColumn(f"_at_{c}", F.explode(F.sequence(cell(number[c] - w, w), cell(number[c] + w, w))))
    out = [F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), *(F.col(f"l.{c}").alias(c) for c in equal)]
    column = lambda side: lambda c: F.col(f"{side}.{c}")
    # Merged, not broadcast: Spark guesses sizes by the files, without the exploded cells.
    met = lambda left, right, cols: left.alias("l").hint("merge").join(right.alias("r"), [*(F.col(f"l.{c}") == F.col(f"r.{c}") for c in cols), F.col(f"l.{key}") < F.col(f"r.{key}")])
    named = met(some, some, [*equal, same])
    near = met(around, placed, [*equal, *(f"_at_{c}" for c in within)]).where(rule(column("l"), column("r")) & ~F.coalesce(F.col(f"l.{same}") == F.col(f"r.{same}"), F.lit(False)))
    return named.select(*out).unionByName(near.select(*out))


def closest(a: DataFrame, x: str, b: DataFrame, y: str, within: float, key: str, other: str) -> DataFrame:
    """For each row of a the row of b that is nearest within a tolerance (an exact hit is), the smaller key of two."""
    left = a.withColumn("_b", F.floor(F.col(x) / within))
    right = b.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(y) / within) + d)))
    near = left.join(right, "_b").where(F.abs(F.col(x) - F.col(y)) <= within)
    return near.groupBy(key).agg(F.min_by(other, F.struct(F.abs(F.col(x) - F.col(y)).alias("d"), F.col(other).alias("k"))).alias(other))


def straddling(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups whose rows are in several parts: an earlier assignment may be used again if there is none."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("n_parts")).where("n_parts > 1")


def patched(df: DataFrame, again: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """df with its null cells filled from a second run, and one row: how many there were, and how many were mended."""
    both = df.join(again.select(key, F.col(column).alias("_new")), key, "left")
    counts = both.agg(F.count_if(F.col(column).isNull()).alias("n_unparsed"), F.count_if(F.col(column).isNull() & F.col("_new").isNotNull()).alias("n_mended"))
    return both.withColumn(column, F.coalesce(column, "_new")).drop("_new"), counts


def best_source(df: DataFrame, by: Sequence[str], priority: Column, *order: str) -> DataFrame:
    """The row of the first source in order of priority, for each group."""
    w = Window.partitionBy(*by).orderBy(priority, *order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
