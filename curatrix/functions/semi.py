"""Semi-structured text: label maps, verdicts and completions. Parsing failures stay apart from all-false labels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import canonical, fold_dashes, to_bool


def json_map(c: Column) -> Column:
    """map<string,string> of a JSON object, also one with single quotes or Python's literals."""
    repaired = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    return F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(repaired, "map<string,string>"))


def braces(c: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def categories(m: Column, names: Sequence[str]) -> Column:
    """struct(flags: the names' booleans in order, n: how many were found, ok): any true spelling of a name wins."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(canonical(e["key"], names).alias("k"), to_bool(e["value"], default=False).alias("v")))
    known = F.filter(entries, lambda e: e["k"].isNotNull())
    hit = lambda n: F.exists(known, lambda e: (e["k"] == n) & e["v"])
    flags = F.array(*(hit(n) for n in names))
    return F.struct(flags.alias("flags"), F.size(F.array_distinct(F.transform(known, lambda e: e["k"]))).alias("n"), m.isNotNull().alias("ok"))


def lookup(m: Column, name: str) -> Column:
    return F.coalesce(F.element_at(m, name), F.element_at(m, name.replace("-", "–")))


def prose_verdict(c: Column) -> Column:
    """True (safe) or false by the last verdict word; null for none."""
    word = F.regexp_extract_all(F.lower(c), F.lit(r"\b(unsafe|not safe|safe)\b"), 1)
    return F.when(F.size(word) > 0, F.element_at(word, -1) == "safe")


def guard_codes(c: Column, names: Sequence[str], prefix: str = "O") -> Column:
    """struct(safe, names): the first verdict line wins; codes stand on the first line with text after it."""
    verdict = F.lower(F.regexp_extract(c, r"(?im)^\s*(safe|unsafe)\s*$", 1))
    line = F.regexp_extract(c, r"(?im)^\s*(?:safe|unsafe)\s*$\s*^([^\n]*)$", 1)
    codes = F.regexp_extract_all(line, F.lit(rf"\b{prefix}(\d+)\b"), 1)
    table = F.array(*(F.lit(n) for n in names))
    hits = F.filter(F.transform(codes, lambda k: F.get(table, k.cast("int") - 1)), lambda x: x.isNotNull())
    return F.struct(F.when(verdict != "", verdict == "safe").alias("safe"), F.when(verdict == "unsafe", F.array_distinct(hits)).otherwise(F.array().cast("array<string>")).alias("names"))


def to_guard(safe: Column, flags: Column, prefix: str = "O") -> Column:
    codes = F.filter(F.transform(flags, lambda f, i: F.when(f, F.concat(F.lit(prefix), (i + 1).cast("string")))), lambda x: x.isNotNull())
    return F.when(safe, F.lit("safe")).otherwise(F.concat(F.lit("unsafe\n"), F.array_join(codes, ",")))


def key_values(c: Column, names: Sequence[str]) -> Column:
    """What can be told of a broken JSON object: name -> value wherever `"name": true/false` stands."""
    pairs = [F.struct(F.lit(n).alias("key"), (F.lower(v) == "true").alias("value")) for n in names for v in [F.regexp_extract(fold_dashes(c), rf'(?i)"{re.escape(n)}"\s*:\s*"?(true|false)', 1)]]
    kept = [F.when(p["value"].isNotNull() & F.lower(c).contains(n.lower()), p) for n, p in zip(names, pairs)]
    return F.map_from_entries(F.array_compact(F.array(*kept)))


def balanced(text: str) -> Iterator[str]:
    """The outermost {...} of a text, braces in strings not counted."""
    depth, start, quoted, escaped = 0, 0, False, False
    for i, ch in enumerate(text):
        if quoted:
            escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            if not depth:
                start = i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]


def _walk(value, depth: int = 0):
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from _walk(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v, depth + 1)


def _truth(value) -> bool | None:
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    return True if word in ("true", "yes", "1", "safe") else False if word in ("false", "no", "0", "unsafe") else None


def _load(text: str):
    """JSON, also with lone backslashes and with truth words as Python or people write them; ValueError for none."""
    words = {"True": "true", "Yes": "true", "False": "false", "No": "false", "None": "null"}
    mended = re.sub(r"(?<=:)\s*(True|Yes|False|No|None)(?=\s*[,}\]])", lambda m: words[m[1]], re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", text))
    try:
        return json.loads(text, strict=False)
    except ValueError:
        return json.loads(mended, strict=False)


def parse_completion(text: str | None, names: Sequence[str], strict: bool = False) -> tuple[bool | None, list[str], str, bool]:
    """(safe, categories, source, complete) of a model's answer: JSON first, then broken JSON, then prose.

    Strict parsing takes whole JSON only. A category found true makes the answer unsafe.
    """
    squeeze = lambda x: re.sub(r"risk$", "", re.sub(r"[^a-z0-9]", "", re.sub(f"[{'‐‑‒–—―−'}]", "-", str(x)).lower()))
    by_key = {squeeze(n): n for n in names}
    text = text or ""
    for candidate in sorted(balanced(text), key=len, reverse=True):
        try:
            found = _load(candidate)
        except ValueError:
            continue
        safe, flags = None, {}
        for node in _walk(found):
            for k, v in node.items():
                if squeeze(k) in ("issafe", "verdict") and safe is None and not isinstance(v, (dict, list)):
                    safe = _truth(v)
                elif squeeze(k) in by_key and not isinstance(v, (dict, list)):
                    flags[by_key[squeeze(k)]] = flags.get(by_key[squeeze(k)], False) or bool(_truth(v))
        if safe is not None or flags:
            hits = [n for n in names if flags.get(n)]
            return (safe if safe is not None else not hits), hits, "json", len(flags) == len(names)
    if strict:
        return None, [], "none", False
    tail = re.search(r'"is_?safe"\s*:\s*"?(true|false)', text, re.I)
    pairs = {by_key[squeeze(k)]: v.lower() == "true" for k, v in re.findall(r'"([^"]+)"\s*:\s*"?(true|false)', text, re.I) if squeeze(k) in by_key}
    if tail or pairs:
        hits = [n for n in names if pairs.get(n)]
        return (tail[1].lower() == "true" if tail else not hits), hits, "partial", False
    said = re.findall(r"\b(unsafe|not safe|safe)\b", text, re.I)
    if said:
        hits = [n for n in names if re.search(re.escape(n) + r"\W+(?:is\s+)?(?:true|yes|present)", text, re.I)]
        return said[-1].lower() == "safe", hits, "prose", False
    return None, [], "none", False


def completion(c: Column, names: Sequence[str], strict: bool = False) -> Column:
    """parse_completion as an Arrow-batched function (braces must be matched, which no built-in does)."""
    names = list(names)

    @F.pandas_udf("safe boolean, categories array<string>, source string, complete boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        known = {x: parse_completion(x, names, strict) for x in s.unique()}
        return pd.DataFrame([known[x] for x in s], columns=["safe", "categories", "source", "complete"])

    return run(c)


