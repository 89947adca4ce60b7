"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is its target share of the epoch over its share of the rows. Each document draws a uniform number from
md5 of the seed and its id and inverts the Poisson distribution function with that rate: 0, 1, 2, ... copies. Copies are
dealt out by a hash and sorted by it, which shuffles them globally. The distribution function of each source is an
array, worked out once for each source; rates over PART are drawn as a sum of smaller Poisson numbers.

The table of sources is joined by broadcast only where it has at most SMALL rows, else by an ordinary join.

Defined results: a null source is a source of its own; sources not named in the weights have weight 1 (or `rest`).
A null id draws by the md5 of its row; rows of one id (and equal rows without one) draw alike, are all replicated and
share their keys, but are dealt to many tasks. Ties of mix_key keep any order. Texts are only looked at where the id is
null; their length doesn't matter. An empty table gives an empty table. All columns are carried; the four that `replicate`
adds replace columns of their names, and `stage` adds none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import packed, partitions, table

SEED = "mix-1"
#: Most rows of a broadcast table of sources; largest rate that is drawn at once; uniform numbers have 52 bits.
SMALL, PART = 10_000, 16.0
#: Partitions over which the rows of one id are dealt.
SPREAD = 64
#: Of the query: names weigh as given, others 1. The epoch has as many copies as there are rows, on average.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}
# Fixed value: terms of the distribution function that matter at a rate of PART (the tail beyond is under 1e-18).
TERMS = 64


def _uniform(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(df: DataFrame, weights: Mapping[str, float], source: str = "source", rest: float = 1.0, epoch: float = 1.0) -> DataFrame:
    """For each source (as `name`) its rate, the number of parts it is drawn in, and the distribution function of a part."""
    name = F.col(f"`{source}`")
    weight = F.lit(rest)
    for known, w in weights.items():
        weight = F.when(F.col("name") == known, float(w)).otherwise(weight)
    counts = df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("w", weight)
    # One row of totals joined back: the table has a row for each source.
    totals = counts.agg(F.sum("n").alias("all"), F.sum("w").alias("sum"))
    rated = counts.join(F.broadcast(totals)).withColumn("rate", F.col("w") / F.col("sum") * F.col("all") * epoch / F.col("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    each = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-each).alias("p"), F.array(F.exp(-each)).alias("c"))

    def add(a: Column, k: Column) -> Column:
        p = a["p"] * each / k
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda a: a["c"])
    return rated.withColumn("parts", parts).select("name", "rate", "parts", cdf.alias("cdf"))


def copies(df: DataFrame, weights: Mapping[str, float], source: str = "source", key: str = "doc_id", seed: str = SEED, rest: float = 1.0, epoch: float = 1.0) -> DataFrame:
    """row (all columns of df as a struct), rate, n_copies, copy (from 0) and mix_key: a row for each copy, dealt by a hash
    of mix_key and in its order within a partition."""
    by_source = rates(df, weights, source, rest, epoch)
    if by_source.limit(SMALL + 1).count() <= SMALL:
        by_source = F.broadcast(by_source)
    # Rows without an id draw by their contents, so they don't all draw alike.
    content = F.md5(F.concat_ws("|", *(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields)))
    who = F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("null:"), content))
    plain = df.select(packed(df).alias("row"), F.col(f"`{source}`").alias("name_of"), who.alias("who"))
    joined = plain.join(by_source, F.col("name_of").eqNullSafe(F.col("name")))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: _uniform(F.lit(seed), i.cast("string"), F.col("who")))
    each = F.transform(draws, lambda u: F.size(F.filter("cdf", lambda c: u >= c)))
    counted = joined.withColumn("n_copies", F.aggregate(each, F.lit(0), lambda a, x: a + x))
    one_each = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.col("who"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    # Rows of one id share their keys: the number of the row within its task (the same when a task runs again) deals them
    # to up to SPREAD partitions.
    dealt = one_each.select("row", "rate", "n_copies", "copy", place.alias("mix_key"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("spread"))
    return dealt.repartition(partitions(df.sparkSession), F.xxhash64("mix_key", "spread")).sortWithinPartitions("mix_key").drop("spread")


def replicate(df: DataFrame, weights: Mapping[str, float], source: str = "source", key: str = "doc_id", seed: str = SEED, rest: float = 1.0, epoch: float = 1.0) -> DataFrame:
    """df with rate, n_copies, copy and mix_key (columns of these names are replaced), a row for each copy."""
    added = ("rate", "n_copies", "copy", "mix_key")
    kept = [f"row.`{c}`" for c in df.columns if c not in added]
    return copies(df, weights, source, key, seed, rest, epoch).select(*kept, *added)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed epoch, with the columns of documents, whatever their names; copies are rows of the same id."""
    return copies(docs, WEIGHTS).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "text", "source", "n_copies", "copy", "mix_key")


_case = " ".join(f"WHEN source = '{k}' THEN {float(v)}" for k, v in WEIGHTS.items())
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, *, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(concat_ws('|', text, lang, source, n_chars))) AS who FROM documents),
c AS (SELECT source, count(*) AS n, CASE {_case} ELSE 1.0 END AS w FROM documents GROUP BY source),
p AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {PART}) AS INTEGER)) AS parts FROM (SELECT source, w / (SELECT sum(w) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c)),
k AS (SELECT unnest(range(0, {TERMS + 1})) AS k),
t AS (SELECT source, parts, k, CASE WHEN k = 0 THEN exp(-rate / parts) ELSE exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) END AS p FROM p, k),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
u AS (SELECT r, source, CAST('0x' || substr(md5('{SEED}' || ':' || i || ':' || who), 1, 13) AS BIGINT) / {float(1 << 52)} AS u
 FROM (SELECT r, d.source, who, unnest(range(1, parts + 1)) AS i FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)),
n AS (SELECT r, CAST(count(*) FILTER (WHERE u >= cdf) AS INTEGER) AS n_copies FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source GROUP BY r),
e AS (SELECT r, n_copies, CAST(unnest(range(0, n_copies)) AS INTEGER) AS copy FROM n)
SELECT doc_id, text, source, n_copies, copy, CAST('0x' || substr(md5('{SEED}:place:' || who || ':' || copy), 1, 15) AS BIGINT) AS mix_key FROM e JOIN d USING (r)"""
