"""Quality rules: a threshold table compiled into one Spark projection of length, symbol, stop-word and line ratios.

Only built-in expressions are used, so the projection runs where the scan runs and nothing is shuffled. Ratios are
compared in whole numbers (100 * part against percent * whole), so every engine decides alike.

Defined results: a null or empty text has no words and fails the base rule; null ids are kept as they are; repeated
rows are judged row by row; an empty table gives an empty table; columns of the input that clash with a measure's name
are left out of the result (only those asked for in `keep` are carried).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import SPACE, table


class Rule(NamedTuple):
    """Percent of `whole` that `part` may be, for texts of at least `from_words` words."""

    name: str
    part: str
    whole: str
    at_least: int
    at_most: int
    from_words: int = 0


# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it was on as with be by this are from or an at not have"
    " der die das und in zu den von mit ist auf im eine ein nicht des dem"
    " le la les de des et un une du que qui dans pour par sur au en est"
    " el los las del y que un una por con para se no lo su"
    " The Of And To In A Is That For It Der Die Das Und Le La Les Des Et El Los Las Que"
).split()

#: Base rule: fewer words than this, or more percent of repeated words, fail a text at once.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", 0, 10),
    Rule("stop_words", "n_stop_words", "n_words", 1, 100, 100),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0, 30),
    Rule("words_per_line", "n_words", "n_lines", 100, 100_000_000),
)


def measures(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each row of df: `keep` and the counts that rules refer to."""
    t = F.coalesce(F.col(text), F.lit(""))
    blanks = F.lit(" \t\n\x0b\x0c\r")
    bare = F.btrim(t, blanks)
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    base = df.select(*keep, t.alias("_t"), words.alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    length = lambda c: F.length(c).cast("long")
    plain = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    counted = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        length(F.translate("_t", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (length(F.col("_t")) - length(F.translate("_t", "#*$%&|<>", ""))).alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    # Hashes of two, four and five words, each from the one before; the last four places are cut off. Every step is
    # used twice by the next, so the optimiser keeps it as a step and doesn't put it inside a lambda.
    follow = lambda a, b, k: F.zip_with(a, F.slice(b, k, F.size(b)), lambda x, y: F.xxhash64(x, y))
    two = counted.select(*plain, "_h", follow("_h", "_h", 2).alias("_two"))
    four = two.select(*plain, "_h", follow("_two", "_two", 3).alias("_four"))
    five = four.select(*plain, F.slice(follow("_four", "_h", 5), 1, F.greatest(F.size("_h") - 4, F.lit(0))).alias("_five"))
    # Only texts in which a window recurs need the places sorted by window.
    pairs = F.sort_array(F.transform("_five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    grams = five.select(*plain, F.when(F.size(F.array_distinct("_five")) < F.size("_five"), pairs).alias("_g"))
    g = F.col("_g")
    twice = F.filter(F.transform(g, lambda x, k: F.when((F.get(g, k - 1)["h"] == x["h"]) | (F.get(g, k + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
    places = grams.select(*plain, F.sort_array(twice).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return places.select(*plain, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """True where every rule of the table holds; a rule with an empty whole or too few words is not asked."""
    passed = F.lit(True)
    for r in rules:
        part, whole = 100 * F.col(r.part), F.col(r.whole)
        passed &= (whole == 0) | (F.col("n_words") < r.from_words) | part.between(r.at_least * whole, r.at_most * whole)
    return passed


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep`, the measures, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # The row number is always there; it keeps a later filter from being moved below the projection, where the
    # optimiser would put whole word lists inside lambdas.
    passed = ~F.col("base_failed") & verdict(rules) & (F.monotonically_increasing_id() >= 0)
    return measures(df, text, keep).withColumn("base_failed", failed).withColumn("kept", passed)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass, with the columns of documents."""
    columns = docs.columns
    return judge(docs.withColumn("_row", F.struct(*columns)), keep=("_row", "text")).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    rules = " AND ".join(f"({r.whole} = 0 OR n_words < {r.from_words} OR 100 * {r.part} BETWEEN {r.at_least} * {r.whole} AND {r.at_most} * {r.whole})" for r in RULES)
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, CAST(count(DISTINCT i + j) AS BIGINT) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
 coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cover USING (r)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {rules}) AS kept FROM f"""


SQL = _sql()
