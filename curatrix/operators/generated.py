"""Checks of generated texts: which labels an edit changed, what a line or a trace may say, and forced continuations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions import semi
from curatrix.functions.text import words

# Words that hedge.
HEDGES = ("might", "perhaps", "possibly", "unclear", "cannot be determined", "i think", "it seems")
NUMBER = r"\d+(?:\.\d+)?"


def changed(a: Column, b: Column, names: Sequence[str]) -> Column:
    """Names whose flags (arrays in the names' order) differ."""
    table = F.array(*map(F.lit, names))
    return F.filter(F.zip_with(table, F.zip_with(a, b, lambda x, y: x != y), lambda n, d: F.when(d, n)), lambda x: x.isNotNull())


def moved(a: Column, b: Column, names: Sequence[str], target: Column, up: Column) -> Column:
    """Whether exactly the target changed, in the given direction."""
    now = F.get(b, F.array_position(F.array(*map(F.lit, names)), target).cast("int") - 1)
    return (F.size(changed(a, b, names)) == 1) & F.coalesce((F.get(changed(a, b, names), F.lit(0)) == target) & (now == up), F.lit(False))


def set_difference(a: Column, b: Column) -> Column:
    """What is in one of two sets only."""
    return F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a)))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters of two texts, twice over their lengths (longest matching blocks, which no built-in finds)."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def edit_notes(old: Column, new: Column, allowed: Column, claimed: Column) -> Column:
    """What is wrong with an edit of a row (maps of its fields): changed fields that may not be, changes that weren't
    claimed, claims that weren't made; an empty array is a pass."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    differ = F.filter(keys, lambda k: ~F.element_at(old, k).eqNullSafe(F.element_at(new, k)))
    note = lambda name, some: F.transform(F.sort_array(some), lambda k: F.concat(F.lit(name + ":"), k))
    none = F.when(F.size(differ) == 0, F.array(F.lit("no change"))).otherwise(F.array().cast("array<string>"))
    return F.concat(none, note("not allowed", F.array_except(differ, allowed)), note("not claimed", F.array_except(differ, claimed)), note("claimed only", F.array_except(claimed, differ)))


def invented_numbers(line: Column, source: Column) -> Column:
    """Numbers of a line that its source doesn't hold."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(NUMBER), 0), lambda x: x.cast("double"))
    return F.array_distinct(F.array_except(numbers(line), numbers(source)))


def line_notes(line: Column, source: Column, least: int = 4, most: int = 40, hedges: Sequence[str] = HEDGES) -> Column:
    """Why a generated line is not taken: its length, hedging, or numbers of its own."""
    low = F.lower(line)
    return F.array_compact(F.array(
        F.when(~words(line).between(least, most), "length"), F.when(F.exists(F.array(*map(F.lit, hedges)), lambda h: F.contains(low, h)), "hedge"), F.when(F.size(invented_numbers(line, source)) > 0, "invented number"),
    ))


def trace_notes(trace: Column, true: Column, headers: Sequence[str], leaks: Sequence[str], tokens: Mapping[str, str], least: int, most: int) -> Column:
    """Why a reasoning trace is not taken: its number of words, absent headers, words that leak the answer, and true
    categories of which it names no token."""
    low, table = F.lower(trace), F.create_map(*(F.lit(x) for pair in tokens.items() for x in pair))
    return F.concat(
        F.array_compact(F.array(F.when(words(trace) < least, "short"), F.when(words(trace) > most, "long"))),
        F.array_compact(F.array(*(F.when(~F.contains(trace, F.lit(h)), F.lit(f"no header {h}")) for h in headers))),
        F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(f"leak {w}")) for w in leaks))),
        F.transform(F.filter(F.sort_array(true), lambda k: ~F.contains(low, F.element_at(table, k))), lambda k: F.concat(F.lit("not named "), k)),
    )


def ceiling_conflicts(c: Column) -> Column:
    """Numbers that a text says exceed something although they are not over the lowest ceiling that it gives."""
    numbers = lambda pattern: F.transform(F.regexp_extract_all(F.lower(c), F.lit(pattern), 1), lambda x: x.cast("double"))
    ceiling = F.array_min(numbers(rf"(?:max(?:imum)?|ceiling|limit|no more than|up to)[^0-9.;]{{0,30}}({NUMBER})"))
    return F.filter(numbers(rf"({NUMBER})[^0-9.;]{{0,40}}exceeds"), lambda x: x <= ceiling)


def forced_prefix(c: Column, name: str) -> Column:
    """The text up to the decision word of the name's line; null where it has none."""
    return F.nullif(F.regexp_extract(c, rf"(?si)^(.*?\Q{name}\E[^\n]*?)\b(?:true|false)\b", 1), F.lit(""))


def styled(word: Column, like: Column) -> Column:
    """The word with the capitals of another: all, the first, or none."""
    return F.when(like == F.upper(like), F.upper(word)).when(F.substring(like, 1, 1) == F.upper(F.substring(like, 1, 1)), F.initcap(word)).otherwise(F.lower(word))


def pretty(safe: Column, flags: Column, names: Sequence[str], reasoning: Column, indent: int = 2) -> Column:
    """The answer as JSON with keys in a fixed order, indented as usual."""
    quote = lambda c: F.substring(F.to_json(F.struct(c.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    inner = F.array_join(F.array(*(F.concat(F.lit(" " * 2 * indent + f'"{n}": '), F.get(flags, i).cast("string")) for i, n in enumerate(names))), ",\n")
    pad = " " * indent
    return F.concat(F.lit("{\n" + pad + '"reasoning": '), quote(reasoning), F.lit(",\n" + pad + '"risk_analysis": {\n'), inner, F.lit("\n" + pad + "},\n" + pad + '"is_safe": '), safe.cast("string"), F.lit("\n}"))


def dump_style(c: Column, safe: Column, flags: Column, names: Sequence[str], reasoning: Column) -> Column:
    """Which indent reproduces a saved answer byte for byte: 2, 4, or null."""
    return F.when(c == pretty(safe, flags, names, reasoning, 2), 2).when(c == pretty(safe, flags, names, reasoning, 4), 4)


def strict_vector(c: Column, names: Sequence[str]) -> Column:
    """struct(safe, flags, ok) of an answer's JSON: the verdict follows from the flags; where nothing parses, the last
    verdict word tells and no flag is set."""
    found = semi.categories(semi.json_map(semi.braces(c)), names)
    ok = found["ok"] & (found["n"] > 0)
    any_ = F.exists(found["flags"], lambda x: x)
    return F.struct(F.when(ok, ~any_).otherwise(semi.prose_verdict(c)).alias("safe"), found["flags"].alias("flags"), F.coalesce(ok, F.lit(False)).alias("ok"))
