"""Rules for scenario rows: profile fields, label map, verdict, dosage and reasoning, as a list for rules.issues.

Rows are all-string tables. `cols` names the columns that hold what the rules look at, so tables with other headings can be
held to the same rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import clinical, semi
from curatrix.functions.text import DASHES, norm, to_bool, to_number
from curatrix.operators.rules import Each, Rule

# What dosages, histories and reasons are held against.
VAGUE = r"\bstandard\b|\busual\b|\btypical\b|\bnormal dos|\bper protocol\b|\broutine\b|\bas indicated\b|\bappropriate dos|\bweight-based\b(?!.*\d)"
ACUTE = ("heparin-induced thrombocytopenia", "hit", "acute", "new onset", "post-op", "postoperative", "septic", "sepsis", "overdose", "myocardial infarction", "stroke", "seizure episode")
HABITS = (
    ("alcohol", ("alcoholic cirrhosis", "alcoholic liver", "alcoholic hepatitis", "alcohol use disorder", "alcoholic pancreatitis"), ("none", "never", "no")),
    ("tobacco", ("copd", "emphysema", "chronic bronchitis", "smoking-related", "lung cancer"), ("never",)),
    ("substance", ("opioid use disorder", "iv drug use", "injection drug", "substance use disorder", "heroin"), ("none", "never", "no")),
)
CITED = ("hemophilia", "cirrhosis", "retinopathy", "endocarditis", "peptic ulcer", "gastric ulcer", "pregnancy", "asthma", "copd", "epilepsy", "glaucoma", "myasthenia", "porphyria", "g6pd", "thrombocytopenia", "neutropenia", "hypothyroid", "hyperthyroid")
DEGREES = ("mild", "moderate", "severe", "end-stage", "profound")
ORGANS = (("renal", "renal"), ("hepatic", "hepatic"), ("liver", "hepatic"), ("kidney", "renal"))
LAZY = ("no contraindication", "no risks identified", "no issues", "nothing of concern", "no concerns", "all clear")
NO_FINDING = ("", "none", "none known", "n/a", "na", "nil", "no")
NO_PREGNANCY = ("not applicable", "n/a", "na", "none", "not pregnant", "no")
BOUNDS = (("age", 0, 120), ("weight", 1, 300), ("height", 30, 250), ("bmi", 8, 80))
CLINICAL = ("genetic", "chronic", "allergies", "renal", "hepatic", "cardiac", "respiratory", "medications")
LAZY_WORDS = 25


def columns(spark: SparkSession, have: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """check_name, detail: missing, extra and misplaced columns (names only; nothing is read)."""
    found = [("schema/missing-column", c) for c in expected if c not in have] + [("schema/extra-column", c) for c in have if c not in expected]
    if [c for c in have if c in expected] != [c for c in expected if c in have]:
        found.append(("schema/column-order", "not in the expected order"))
    return spark.createDataFrame(found, "check_name string, detail string")


def same_schema(a: DataFrame, b: DataFrame) -> list[str]:
    """What keeps b from being appended to a: names and types that differ, in order; an empty list is a pass."""
    x, y = ([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] for df in (a, b))
    return [f"{i}: {p} | {q}" for i, (p, q) in enumerate(zip(x + ["-"] * (len(y) - len(x)), y + ["-"] * (len(x) - len(y)))) if p != q]


def empty_fields(cols: Sequence[str], required: Sequence[str]) -> list[Rule]:
    return [Rule("field/empty", "error" if c in required else "warning", norm(F.col(f"`{c}`")) == "", F.lit(c)) for c in cols]


def label_map(c: Column, names: Sequence[str], safe: Column) -> list[Rule | Each]:
    """The map's text and keys, and that the verdict says whether any name is true."""
    plain, m = F.from_json(c, "map<string,string>", {"allowSingleQuotes": "false"}), semi.json_map(c)
    keys, known = F.map_keys(m), F.array(*map(F.lit, names))
    odd = F.filter(F.map_entries(m), lambda e: ~F.lower(e["value"]).isin("true", "false"))
    yes = F.filter(F.map_entries(m), lambda e: F.lower(e["value"]) == "true")
    declared, told = to_bool(safe), F.exists(F.map_values(m), lambda v: F.lower(v).isin("true", "false"))
    return [
        Rule("categories/unparseable", "error", m.isNull(), F.lit("not an object")),
        Rule("categories/needed-repair", "warning", plain.isNull() & m.isNotNull(), F.lit("quotes or truth words")),
        Each("categories/fancy-dash", "error", F.filter(keys, lambda k: k.rlike(f"[{DASHES}]"))),
        Each("categories/missing-key", "error", F.array_except(known, keys)),
        Each("categories/unknown-key", "error", F.array_except(keys, known)),
        Each("categories/non-boolean", "error", F.transform(odd, lambda e: e["key"])),
        Rule("is_safe/unparseable", "error", declared.isNull(), safe),
        Rule("is_safe/mismatch", "error", told & (declared != (F.size(yes) == 0)), F.size(yes)),
    ]


def body(cols: Mapping[str, str], within: float = 0.2) -> list[Rule]:
    """BMI arithmetic and plausible ranges."""
    w, h, b = (to_number(F.col(f"`{cols[k]}`")) for k in ("weight", "height", "bmi"))
    made = [
        Rule("bmi/non-numeric", "warning", w.isNull() | h.isNull() | b.isNull(), F.concat_ws("|", *(F.col(f"`{cols[k]}`") for k in ("weight", "height", "bmi")))),
        Rule("bmi/bad-height", "error", w.isNotNull() & b.isNotNull() & (h <= 0), h),
        Rule("bmi/arithmetic", "error", (h > 0) & (F.abs(clinical.bmi(w, h) - b) > within), F.round(clinical.bmi(w, h), 1)),
    ]
    for k, lo, hi in BOUNDS:
        raw, v = F.col(f"`{cols[k]}`"), to_number(F.col(f"`{cols[k]}`"))
        made += [Rule("range/non-numeric", "warning", raw.isNotNull() & v.isNull(), F.lit(cols[k])), Rule("range/implausible", "error", ~v.between(lo, hi), F.lit(cols[k]))]
    return made


def dosage(c: Column) -> list[Rule]:
    low = norm(c)
    return [
        Rule("dosage/empty", "error", low == "", F.lit("empty")),
        Rule("dosage/vague", "warning", low.rlike(VAGUE), c),
        Rule("dosage/no-number", "error", (low != "") & ~low.rlike(r"\d"), c),
    ]


def history(cols: Mapping[str, str]) -> list[Rule]:
    """Pregnancy of men, acute events among chronic conditions, habits that a condition contradicts."""
    get = lambda k: norm(F.col(f"`{cols[k]}`"))
    pregnant, told = get("pregnancy"), F.concat_ws(" ", get("chronic"), get("diagnosis"), get("genetic"))
    first = lambda c, terms: F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t)), F.lit(0))
    made = [
        Rule("pregnancy/male", "error", get("sex").startswith("m") & (pregnant != "") & ~pregnant.isin(*NO_PREGNANCY), pregnant),
        Rule("pregnancy/empty", "warning", pregnant == "", F.lit("empty")),
        Rule("field/acute-in-chronic", "warning", first(get("chronic"), ACUTE).isNotNull(), first(get("chronic"), ACUTE)),
    ]
    for field, terms, denied in HABITS:
        made.append(Rule("consistency/substance", "error", first(told, terms).isNotNull() & get(field).rlike("^(" + "|".join(denied) + ")"), F.concat(first(told, terms), F.lit(" | "), get(field))))
    return made


def _holds(c: Column, terms: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def reasoning(cols: Mapping[str, str], profile: Sequence[str]) -> list[Rule | Each]:
    """Conditions and degrees that the reasoning cites must stand in the profile; a safe row needs reasons and findings."""
    get = lambda k: norm(F.col(f"`{cols[k]}`"))
    said, safe = get("reasoning"), to_bool(F.col(f"`{cols['safe']}`"))
    known = F.concat_ws(" ", *(norm(F.col(f"`{c}`")) for c in profile), get("diagnosis"))
    made: list[Rule | Each] = [
        Rule("reasoning/empty", "error", said == "", F.lit("empty")),
        Each("reasoning/ungrounded", "error", F.filter(F.array(*map(F.lit, CITED)), lambda t: F.contains(said, t) & ~F.contains(known, t))),
    ]
    for organ, field in ORGANS:
        claimed, actual = F.regexp_extract(said, rf"([\w-]+)\s+{organ}", 1), get(field)
        other = _holds(actual, DEGREES)
        made.append(Rule("reasoning/severity-mismatch", "warning", claimed.isin(*DEGREES) & (F.size(other) > 0) & ~F.contains(actual, claimed), F.concat(claimed, F.lit(f" {organ} | "), actual)))
    words = F.size(F.filter(F.split(said, r"\s+"), lambda w: w != ""))
    lazy = F.exists(F.array(*map(F.lit, LAZY)), lambda p: F.contains(said, p))
    return [
        *made,
        Rule("reasoning/lazy-safe", "warning", safe & lazy & (words < LAZY_WORDS), words),
        Rule("balance/trivially-safe", "warning", safe & (findings(cols) == 0), F.lit("no finding")),
    ]


def findings(cols: Mapping[str, str], fields: Sequence[str] = CLINICAL) -> Column:
    """How many clinical fields say something."""
    return sum((F.when(norm(F.col(f"`{cols[k]}`")).isin(*NO_FINDING), 0).otherwise(1) for k in fields), F.lit(0))


def scenario(cols: Mapping[str, str], names: Sequence[str], profile: Sequence[str], required: Sequence[str]) -> list[Rule | Each]:
    """All rules of a scenario table; cols gives the headings of the fields that the rules know by name."""
    return [*empty_fields(list(cols.values()), required), *label_map(F.col(f"`{cols['labels']}`"), names, F.col(f"`{cols['safe']}`")), *body(cols), *dosage(F.col(f"`{cols['dosage']}`")), *history(cols), *reasoning(cols, profile)]


def varies(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose value neither holds nor stands in the most frequent one, if more than half of the rows have that: key,
    check_name, severity, detail. The mode is one row."""
    value = norm(F.col(column))
    counts = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    mode = counts.agg(F.max(F.struct("n", F.col("v"))).alias("m"), F.sum("n").alias("all")).where("2 * m.n > all").select(F.col("m.v").alias("mode"))
    odd = (value != "") & ~F.contains(value, F.col("mode")) & ~F.contains(F.col("mode"), value)
    return df.join(F.broadcast(mode)).where(odd).select(key, F.lit("medication/varies").alias("check_name"), F.lit("info").alias("severity"), F.col(column).alias("detail"))


def by_heading(headings: Sequence[str]) -> list[Rule]:
    """Rules for the columns whose headings say what they hold: numbers in ranges, sexes, dosages and durations."""
    made: list[Rule] = []
    for h in headings:
        c, low = F.col(f"`{h}`"), h.lower()
        for k, lo, hi in BOUNDS:
            if k in low:
                made.append(Rule(f"feature/{k}", "error", c.isNotNull() & ~F.coalesce(to_number(c).between(lo, hi), F.lit(False)), c))
        if "gender" in low or "sex" in low:
            made.append(Rule("feature/sex", "error", ~norm(c).isin("male", "female", "m", "f", "other", "unknown"), c))
        if "dos" in low:
            made += [r._replace(check="feature/" + r.check) for r in dosage(c)]
        if "duration" in low:
            made.append(Rule("feature/duration", "warning", clinical.duration_class(c).isin("unspecified", "not_reported"), c))
    return made


def evidence(table: Mapping[str, Column]) -> Column:
    """The categories whose condition holds: what a profile gives grounds for."""
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in table.items())))


def eligible(flags: Mapping[str, Column], table: Mapping[str, Column], direction: str) -> Column:
    """Categories that can be moved: `add` those that are false without grounds, `drop` those that are true."""
    chosen = {k: ~flags[k] & ~F.coalesce(table.get(k, F.lit(False)), F.lit(False)) if direction == "add" else flags[k] for k in flags}
    return evidence(chosen)


def select_rows(df: DataFrame, key: str, start: Column | int | None = None, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Rows from a key on, those of a table of keys, and the first by key: each where it is given."""
    out = df if start is None else df.where(F.col(key) >= start)
    out = out if ids is None else out.join(ids.select(key).distinct(), key, "left_semi")
    return out if limit is None else out.orderBy(key).limit(limit)
