"""Column functions for text: normalising, tokens, patterns, bands and cleaning. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the two truth values, and of a missing cell.
TRUE_WORDS = ("true", "1", "yes", "y", "t", "safe")
FALSE_WORDS = ("false", "0", "no", "n", "f", "unsafe")
NULL_WORDS = ("", "none", "n/a", "na", "nan", "null", "-")
DASHES = "‐‑‒–—―−"
QUOTES = "‘’‚‛“”„‟«»\u00a0\u2009\u202f…"


def norm(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def null_if(c: Column, tokens: Sequence[str] = NULL_WORDS) -> Column:
    """Null where the trimmed lower-case cell is one of the tokens."""
    return F.when(~norm(c).isin(list(tokens)), c)


def to_bool(c: Column, true: Sequence[str] = TRUE_WORDS, false: Sequence[str] = FALSE_WORDS, default: bool | None = None) -> Column:
    """Three-valued: what is in neither list gives the default."""
    return F.when(norm(c).isin(list(true)), True).when(norm(c).isin(list(false)), False).otherwise(F.lit(default).cast("boolean"))


def to_number(c: Column) -> Column:
    """Null for what is no number."""
    return F.trim(c).try_cast("double")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1))


def identity_key(*columns: Column) -> Column:
    """One key of several cells: normalised, blanks collapsed, joined by a bar."""
    return F.md5(F.concat_ws("|", *(F.regexp_replace(norm(c), r"\s+", " ") for c in columns)))


def fancy_dashes(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"([{DASHES}])"), 1))


def format_signature(c: Column) -> Column:
    """Runs of digits become 9, runs of letters A, runs of blanks one blank."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{L}+", "A"), r"[0-9]+", "9"), r"\s+", " ")


def fold_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def canonical(c: Column, names: Sequence[str], suffix: str = "risk") -> Column:
    """The name whose letters and digits equal the cell's, with or without the suffix; null for none."""
    squeeze = lambda x: F.regexp_replace(F.lower(x), r"[^a-z0-9]", "")
    bare = lambda x: F.regexp_replace(squeeze(x), f"{suffix}$", "")
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(bare(fold_dashes(c)) == bare(F.lit(name)), F.lit(name)).otherwise(out)
    return out


def rewrite(c: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Ordered rewrites; the text and how many replacements were made."""
    count = F.lit(0)
    for pattern, new in rules:
        count = count + F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, pattern, new)
    return c, count


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def drop_sentences(c: Column, pattern: str) -> Column:
    return F.array_join(F.filter(sentences(c), lambda s: ~s.rlike(pattern)), " ")


def tidy(c: Column) -> Column:
    """No blank before a stop, one blank between words, no doubled stops."""
    for pattern, new in ((r"[ \t]+", " "), (r" +([,.;:!?])", "$1"), (r"([,;:])[,;:]+", "$1"), (r"\.{2,}", "."), (r"^ | $", "")):
        c = F.regexp_replace(c, pattern, new)
    return c


def whole_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d+)\.0+$", "$1")


def split_list(c: Column) -> Column:
    """Items between ; or , that are not in brackets (one level), without the dots and blanks around them."""
    items = F.regexp_extract_all(c, F.lit(r"(?:[^;,(\[]++|[(\[][^)\]]*+[)\]]?)++"), 0)
    return F.filter(F.transform(items, lambda x: F.btrim(x, F.lit(" ."))), lambda x: x != "")


def split_items(c: Column, nothing: Sequence[str] = ("", "none", "none known", "nkda", "n/a", "na")) -> Column:
    """Items of a list: at every ; where there is one, else at commas outside round brackets (one level). A text that says
    nothing has no items."""
    comma = F.regexp_extract_all(c, F.lit(r"(?:[^,(]++|\([^)]*+\)?)++"), 0)
    items = F.transform(F.when(c.contains(";"), F.split(c, ";")).otherwise(comma), lambda x: F.trim(x))
    return F.when(norm(c).isin(list(nothing)), F.array().cast("array<string>")).otherwise(F.filter(items, lambda x: x != ""))


def strip_brackets(c: Column, words: Sequence[str]) -> Column:
    """The text without the brackets (and the blank before them) that hold one of the words, in any case."""
    some = "|".join(f"\\Q{w}\\E" for w in words)
    return F.trim(F.regexp_replace(c, rf"(?i)\s*\([^()]*(?:{some})[^()]*\)", "")) if words else c


def headers(c: Column, names: Mapping[str, str]) -> Column:
    """Lines that are a header in any of its spellings (case, bold, numbering, colon) become its one form."""
    for said, one in names.items():
        c = F.regexp_replace(c, rf"(?im)^[ \t]*(?:#+[ \t]*)?(?:\d+[.)][ \t]*)?\**[ \t]*\Q{said}\E[ \t]*\**:?\**[ \t]*$", one)
    return c


def first_header(c: Column, names: Sequence[str]) -> Column:
    """The first of the headers that begins a line; null for none."""
    some = "|".join(f"\\Q{n}\\E" for n in names)
    return F.nullif(F.regexp_extract(c, rf"(?m)^({some})", 1), F.lit(""))


def forbidden(c: Column, words: Sequence[str]) -> Column:
    """Those of the words that the text holds: what must not be told to a blind reader."""
    return F.array_compact(F.array(*(F.when(c.contains(w), F.lit(w)) for w in words)))


def placeholder(c: Column, shown: str = "Not reported", null: Sequence[str] = NULL_WORDS) -> Column:
    """The trimmed cell, or what is shown for a missing one."""
    return F.coalesce(F.trim(null_if(c, null)), F.lit(shown))


def approx_tokens_of(chars: Column) -> Column:
    return chars / 4


def approx_tokens(c: Column) -> Column:
    return approx_tokens_of(F.length(c))


def percent(c: Column) -> Column:
    """A share as a percentage of one digit, nudged up by 1e-9 and rounded half to even."""
    return F.bround(100 * c + 1e-9, 1)


def straight_quotes(c: Column) -> Column:
    """Typographic quotes, dashes and blanks as ASCII."""
    return F.translate(fold_dashes(c), QUOTES, "'" * 4 + '"' * 6 + " " * 3 + ".")


def demographics(c: Column) -> Column:
    """What a text tells of a person: ages, sexes, weights and body mass."""
    words = r"(?i)\b(\d{1,3}[- ]?(?:year|yr)s?[- ]?old|aged? \d{1,3}|(?:fe)?male|(?:wo)?m[ae]n|\d{2,3}(?:\.\d)? ?kg|bmi(?: of)? \d{2}(?:\.\d)?)\b"
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(words), 1), lambda x: F.lower(x)))


def band(c: Column, edges: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first edge that the value is below, else the last name."""
    out = F.lit(last)
    for below, name in reversed(edges):
        out = F.when(c < below, F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def bullets(c: Column) -> Column:
    """Lines '- Name: value' as a map; the first of a repeated name counts."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*[-*]\s*[^:]+:"))
    pair = lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*[-*]\s*([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^\s*[-*]\s*[^:]+:(.*)$", 1)).alias("value"))
    pairs = F.transform(lines, pair)
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))


def flip_word(c: Column, first: str, second: str) -> Column:
    """The first of the two words that occurs becomes the other one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"\\b{first}\\b", "\u0001"), f"\\b{second}\\b", first), "\u0001", second)
