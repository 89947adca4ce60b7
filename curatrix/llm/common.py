"""What the operators share: the cluster's shared folder, spilled tables, null-safe keys and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and the driver
    is the only machine (local tests). Elsewhere an unset folder is an error, as executors couldn't read each other's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (root or f"file://{tempfile.gettempdir()}/curatrix-shared-{os.getuid()}").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/curatrix/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, under which no column's name can clash."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def row_hash(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """A hash of a row's columns (but those left out), the same on every run; maps go as JSON."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in leave]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, '' for null."""
    return F.coalesce(df[column], F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def least(df: DataFrame, group: str, rank: str, n: int) -> DataFrame:
    """The n rows of least rank (hashes, as long) of each group, with `_r` from 1; for few groups of any size.

    The upper 12 bits of the ranks are counted first, so that only rows of the buckets up to that of the n-th are
    sorted: n and one part in 4,096 of the group.
    """
    bucket = F.shiftright(rank, 52)
    counts = df.groupBy(group, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < n).groupBy(group).agg(F.max("_b").alias("_last"))
    near = df.join(F.broadcast(last), group).where(bucket <= F.col("_last")).drop("_last")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(rank))).where(F.col("_r") <= n)


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], often: int, most: int = 10_000, how: str = "inner") -> DataFrame:
    """rows joined with counted: a written table of one row a key, with `n`, how many of the rows have that key.

    The `most` most frequent keys among those of over `often` rows meet their rows by broadcast (`most` rows: a bound that
    doesn't grow), so a hot key stays where its rows are. All others meet in a sort-merge join; the partitions of keys
    that are frequent there are split by adaptive execution (spark.sql.adaptive.skewJoin, on by default).
    how: inner or left.
    """
    heavy = F.broadcast(counted.where(F.col("n") > often).orderBy(F.desc("n"), *on).limit(most))
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rest.join(counted, on, how).unionByName(rows.join(heavy, on))


def components(edges: DataFrame, name: str = "components", small: int = 100_000) -> DataFrame:
    """Smallest vertex reachable over the edges (a, b): one row (v, c) for each vertex that has an edge.

    Contraction: every vertex points at its least neighbour, pointers are halved once, and the edges move to
    the roots. Vertices are hashes, so runs of falling vertices are short and the number of edges falls geometrically
    (of vertices in the order of a path it would not). Every round is written to the shared folder. Nothing is
    collected but one count a round.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    live = spill(both, f"{name}-edges")
    maps: list[DataFrame] = []
    while live.limit(1).count():
        near = live.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("w")))
        hook = near.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = spill(hook.join(up, "p", "left").select("v", F.least("p", F.coalesce("pp", "p")).alias("p")), f"{name}-step")
        maps.append(step)
        a, b = (step.select(F.col("v").alias(k), F.col("p").alias(f"n{k}")) for k in ("a", "b"))
        live = spill(live.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    if not maps:
        return both.select(F.col("a").alias("v"), F.col("b").alias("c")).limit(0)
    label = maps[0].select("v", F.col("p").alias("c"))
    for step in maps[1:]:
        nxt = step.select(F.col("v").alias("c"), F.col("p").alias("nc"))
        label = label.join(nxt, "c", "left").select("v", F.coalesce("nc", "c").alias("c"))
    return spill(label, name)
