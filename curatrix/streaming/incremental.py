"""Incremental batch work: last write wins, what is still to do, and streaming versions of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; one aggregation, no window."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("_r"))
    return last.select(key, "_r.*")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def compact(stream: DataFrame, key: str, order: tuple[str, ...], path: str, checkpoint: str):
    """Runs over what has arrived since the last run, and writes the compacted table beside the old one.

    Each batch writes a version folder of its number; a rerun batch writes the same version. Readers take the last whole
    version (`current`). Older versions may be deleted at any time.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        both = batch
        if number:
            both = spark.read.schema(schema).parquet(f"{path}/v{number - 1}").unionByName(batch)
        last_write(both, key, *order).select(*schema.names).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame | None:
    """The last version whose write was committed; None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at(path)):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(at(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v{max(whole)}") if whole else None


def windowed(stream: DataFrame, time: str, late: str, size: str, *by: str) -> DataFrame:
    """Counts by tumbling window with a watermark (an extension; the batch operators need none)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("from"), *by, "n")
