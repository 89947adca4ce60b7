"""Named queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """t.orders is the table orders of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def add(name: str, sql: str | None, f: Callable[[Tables], DataFrame]) -> None:
    """Registers a function of Tables under a name."""
    _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    if sql:
        _SQL[name] = sql


def _load() -> None:
    from curatrix.plans import curation, evaluation, golden, pairs, parsing, records, reports, sampling  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict report by language, free of exact copies and of documents that hold a benchmark passage."""
    return queries()["leakage_screened_report"](spark, sf_dir)
