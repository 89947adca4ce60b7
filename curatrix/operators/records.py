"""Chat records: building, injecting, blinding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chat(df: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """One text a conversation, turns in order."""
    turns = F.array_sort(F.collect_list(F.struct(order, role, content)))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), turns.alias("_t")).select(key, "n_turns", F.array_join(F.transform("_t", lambda x: F.concat(x[role], F.lit(": "), x[content])), "\n").alias("chat"))


def inject(df: DataFrame, key: str, order: str, role: str, content: str, context: str) -> DataFrame:
    """The context before the first user turn, once."""
    first = F.min(F.when(F.col(role) == "user", F.col(order))).over(Window.partitionBy(key))
    here = (F.col(role) == "user") & (F.col(order) == first) & ~F.coalesce(F.startswith(F.col(content), F.lit(context)), F.lit(False))
    return df.withColumn(content, F.when(here, F.concat(F.lit(context + "\n"), F.col(content))).otherwise(F.col(content)))


def user_message(fields: Mapping[str, Column], scenario: Column, absent: str = "Not reported") -> Column:
    lines = [F.concat(F.lit(f"- {name}: "), F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(absent))) for name, c in fields.items()]
    return F.concat_ws("\n", F.lit("Patient profile:"), *lines, F.lit(""), F.lit("Scenario:"), scenario)


def nonpersonal(message: Column) -> Column:
    """The message without its profile block."""
    return F.regexp_replace(message, r"(?s)^Patient profile:\n(?:- [^\n]*\n?)*\n*", "")


def blind(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    return df.drop(*hidden)
