"""A search for a group-disjoint split: many hashed restarts scored at once, then moves and swaps.

The restarts are rows (group x restart) that aggregate on the map side to three rows a restart, so their cost is linear
in the groups. The moves and swaps see all groups, whose rows come to the driver (one a group).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = ("train", "validation", "test")
SHARES = (0.75, 0.10, 0.15)
#: Weights of the objective: size, labels missing, labels under three, proportions, verdict rates.
WEIGHTS = (100.0, 3.0, 0.5, 8.0, 2.0)


def _part(group: str, restart: Column, shares: Sequence[float], seed: str) -> Column:
    """0, 1 or 2 by hash: md5's first eight digits against the shares."""
    x = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), restart.cast("string"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return F.when(x < shares[0], 0).when(x < shares[0] + shares[1], 1).otherwise(2)


def groups(rows: DataFrame, group: str, unsafe: Column, labels: Sequence[Column]) -> DataFrame:
    """group, n, unsafe and pos, an array of how many rows carry each label."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(unsafe.cast("long")).alias("unsafe"), F.array(*(F.sum(x.cast("long")) for x in labels)).alias("pos"))


def scores(stats: DataFrame, group: str, n_labels: int, restarts: int, seed: str, shares: Sequence[float] = SHARES) -> DataFrame:
    """restart and score (less is better) of every hashed assignment, rounded to nine digits."""
    add = lambda k: [F.sum(F.get("pos", F.lit(i))).alias(f"p{i}") for i in range(k)]
    many = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))
    part = many.withColumn("part", _part(group, F.col("restart"), shares, seed))
    held = part.groupBy("restart", "part").agg(F.sum("n").alias("n"), F.sum("unsafe").alias("u"), *add(n_labels))
    whole = Window.partitionBy("restart")
    tot = lambda c: F.sum(c).over(whole)
    target = F.get(F.array(*map(F.lit, shares)), F.col("part"))
    size = F.abs(F.col("n") - target * tot("n")) / tot("n")
    pos = [F.col(f"p{i}") for i in range(n_labels)]
    small = F.col("part") > 0
    missing = sum((F.when(small & (p == 0), 1.0).otherwise(0.0) for p in pos), F.lit(0.0))
    thin = sum((F.when(small & (p < 3), 1.0).otherwise(0.0) for p in pos), F.lit(0.0))
    prop = sum((F.abs(p / F.greatest(tot(f"p{i}"), F.lit(1)) - F.col("n") / tot("n")) for i, p in enumerate(pos)), F.lit(0.0)) / (3 * n_labels)
    rate = F.abs(F.col("u") / F.greatest("n", F.lit(1)) - tot("u") / tot("n"))
    cost = held.select("restart", "part", sum((w * x for w, x in zip(WEIGHTS, (size, missing, thin, prop, rate))), F.lit(0.0)).alias("x"), tot("n").alias("_n"), tot("u").alias("_u"))
    # A part that no group fell into has no row: it lacks its whole size, every label, and the verdict rate.
    gone = [F.when(F.count_if(F.col("part") == k) == 0, WEIGHTS[0] * shares[k] + (WEIGHTS[1] + WEIGHTS[2]) * n_labels * (k > 0) + WEIGHTS[4] * F.max(F.col("_u") / F.col("_n"))).otherwise(0.0) for k in range(3)]
    return cost.groupBy("restart").agg(F.round(F.sum("x") + sum(gone, F.lit(0.0)), 9).alias("score"))


def _objective(np, size, pos, unsafe, shares):
    n, tot = size.sum(), np.maximum(pos.sum(0), 1)
    held = np.maximum(size, 1)
    w = WEIGHTS
    rest = pos[1:]
    return (
        w[0] * np.abs(size / n - np.array(shares)).sum() + w[1] * (rest == 0).sum() + w[2] * (rest < 3).sum()
        + w[3] * np.abs(pos / tot - (size / n)[:, None]).mean() + w[4] * np.abs(unsafe / held - unsafe.sum() / n).sum()
    )


def improve(stats: DataFrame, assigned: DataFrame, group: str, shares: Sequence[float] = SHARES, movable: int | None = None, sweeps: int = 4) -> DataFrame:
    """Moves and swaps of all groups, or of the `movable` largest (ties by group), while the objective falls. Swaps are tried
    with the next eight by size, and between as many pairs drawn from all of them as there are groups, in each sweep."""
    import numpy as np

    spark = stats.sparkSession
    both = stats.join(assigned, group)
    k = len(stats.select("pos").first()[0]) if stats.limit(1).count() else 0
    if not k:
        return assigned
    held = {r["part"]: r for r in both.groupBy("part").agg(F.sum("n").alias("n"), F.sum("unsafe").alias("unsafe"), F.array(*(F.sum(F.get("pos", F.lit(i))) for i in range(k))).alias("pos")).collect()}
    size, unsafe, pos = np.zeros(3), np.zeros(3), np.zeros((3, k))
    for p, r in held.items():
        size[p], unsafe[p], pos[p] = r["n"], r["unsafe"], r["pos"]
    ordered = both.orderBy(F.desc("n"), group)
    some = (ordered if movable is None else ordered.limit(movable)).collect()
    part = [r["part"] for r in some]
    vec = [(r["n"], r["unsafe"], np.array(r["pos"], float)) for r in some]

    def shift(i: int, to: int) -> None:
        for p, sign in ((part[i], -1), (to, 1)):
            size[p] += sign * vec[i][0]
            unsafe[p] += sign * vec[i][1]
            pos[p] += sign * vec[i][2]
        part[i] = to

    best = _objective(np, size, pos, unsafe, shares)
    for sweep in range(sweeps):
        before = best
        for i in range(len(some)):
            home = part[i]
            for to in range(3):
                if to != home:
                    shift(i, to)
                    if (now := _objective(np, size, pos, unsafe, shares)) < best - 1e-12:
                        best, home = now, to
                    else:
                        shift(i, home)
        near = ((i, j) for i in range(len(some)) for j in range(i + 1, min(len(some), i + 9)))
        drawn = np.random.default_rng(sweep).integers(0, max(len(some), 1), (len(some), 2)).tolist()
        for i, j in chain(near, drawn):
            a, b = part[i], part[j]
            if a != b:
                shift(i, b), shift(j, a)
                if (now := _objective(np, size, pos, unsafe, shares)) < best - 1e-12:
                    best = now
                else:
                    shift(i, a), shift(j, b)
        if best >= before - 1e-12:
            break
    moved = spark.createDataFrame([(r[group], p) for r, p in zip(some, part)], assigned.select(group, F.col("part").cast("int").alias("_p")).schema)
    return assigned.join(moved, group, "left").select(group, F.coalesce("_p", "part").alias("part"))


def search(stats: DataFrame, group: str, n_labels: int, restarts: int = 400, seed: str = "search", refine: bool = True) -> DataFrame:
    """group and part (a name) of the best assignment found."""
    best = scores(stats, group, n_labels, restarts, seed).orderBy("score", "restart").first()
    at = stats.select(group, _part(group, F.lit(best["restart"] if best else 0), SHARES, seed).alias("part"))
    at = improve(stats, at, group) if refine else at
    return at.select(group, F.get(F.array(*map(F.lit, PARTS)), F.col("part")).alias("part"))


def probe(train: DataFrame, test: DataFrame, key: str, text: str, label: str, features: int = 1 << 18, iterations: int = 50) -> DataFrame:
    """key, label, p, predicted of the test rows: logistic regression on hashed word uni- and bigrams, counts damped by
    1 + log, weighted by inverse document frequency and scaled to unit length. Null texts count as empty."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    def grams(df: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        pairs = F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return df.select(key, F.col(label).cast("double").alias("label"), words.alias("_w")).withColumn("_g", F.concat("_w", pairs))

    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def damp(v):
        import numpy as np

        return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))

    tf = HashingTF(numFeatures=features, inputCol="_g", outputCol="_c")
    ready = lambda df: tf.transform(grams(df)).select(key, "label", damp("_c").alias("_t"))
    model = Pipeline(stages=[IDF(inputCol="_t", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="label", maxIter=iterations, regParam=1e-4, probabilityCol="_p")]).fit(ready(train))
    out = model.transform(ready(test))
    return out.select(key, F.col("label").cast("int").alias("label"), F.get(vector_to_array("_p"), F.lit(1)).alias("p"), F.col("prediction").cast("int").alias("predicted"))
