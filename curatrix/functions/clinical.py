"""Clinical free text to typed values: organ status, habits, doses, frequencies, routes and durations, and the vectors made
of them. Built-in expressions; every parser gives a struct whose fields are null where the text doesn't say."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import band, split_list

# Spellings and clinical bounds; within a table the first pattern that is found counts.
BLANK = ("", "nan", "null", "<na>", "none", "n/a")
NEGATIVE = r"(?i)^\s*(none|no\b|normal|nkda|n/?a\b|not applicable|never|denies|healthy|no known|no history|not reported|non-?smoker|normotensive|negative|nil)"
MG = (("mcg", 0.001), ("µg", 0.001), ("ug", 0.001), ("mg", 1.0), ("g", 1000.0))
PER_DAY = (
    (r"\b(q|every)\s*4\s*(h|hours?)\b", 6.0),
    (r"\b(q|every)\s*6\s*(h|hours?)\b|\bqid\b|four times (a |per )?(day|daily)", 4.0),
    (r"\b(q|every)\s*8\s*(h|hours?)\b|\btid\b|(three times|thrice) (a |per )?(day|daily)", 3.0),
    (r"\b(q|every)\s*12\s*(h|hours?)\b|\bbid\b|\bb\.i\.d\b|(twice|two times) (a |per )?(day|daily)", 2.0),
    (r"\bq8-?12h\b", 3.0),
    (r"once (a |per )?(day|daily)|\bdaily\b|\bqd\b|\bod\b|nightly|at bedtime|\bqhs\b|\bqam\b|\bqpm\b|/day|per day|every (day|morning|evening|night)", 1.0),
    (r"every other day|\bqod\b|alternate days", 0.5),
    (r"(twice|two times) (a |per )?week", 2 / 7),
    (r"once (a |per )?week|weekly|/week", 1 / 7),
    (r"every 2 weeks|biweekly|fortnight", 1 / 14),
    (r"monthly|once (a |per )?month|every 4 weeks", 1 / 30),
)
ROUTES = (
    ("oral", r"\bpo\b|oral|by mouth|tablet|capsule|swallow"), ("IV", r"\biv\b|intravenous"), ("IM", r"\bim\b|intramuscular"), ("SC", r"\bsc\b|\bsq\b|subcut"),
    ("topical/transdermal", r"topical|cream|ointment|gel\b|patch|transdermal"), ("inhaled", r"inhal|puff|nebul|mdi\b"), ("rectal", r"\bpr\b|rectal|suppositor"),
    ("sublingual", r"sublingual|\bsl\b"), ("nasal", "nasal"), ("ophthalmic", "ophthalmic|eye drop"), ("neuraxial", "epidural|intrathecal|spinal"),
)
DEGREES = (("severe", r"\bsevere\b"), ("moderate", r"\bmoderate\b"), ("mild", r"\bmild\b"))
KIDNEY_FAILURE = ("kidney failure / dialysis", r"esrd|end[- ]stage|dialysis|kidney failure")
#: Clearance below which a status begins, in ml/min.
CLEARANCE = ((15, "kidney failure / dialysis"), (30, "severe"), (60, "moderate"), (90, "mild"))
HEART = (
    ("atrial fibrillation", r"atrial fib|afib|\baf\b"), ("heart failure / reduced EF", r"heart failure|hfref|hfpef|\bchf\b|cardiomyopathy"), ("QT prolongation", "long qt|qt prolong"),
    ("hypertension", r"hypertens|\bhtn\b"), ("coronary disease", r"coronary|\bcad\b|\bmi\b|infarction|stent|angina"), ("bradycardia / conduction", r"bradycard|heart block|\bav block"),
    ("ventricular arrhythmia", r"\bvt\b|ventricular tach|arrhythm"),
)
LOW_EF, LONG_QTC = 50, 450
LUNG = (("asthma", "asthma"), ("COPD", "copd|emphysema|chronic bronchitis"), ("sleep apnea", r"sleep apn|osa\b"), ("interstitial lung disease", r"fibrosis|\bild\b|interstitial"))
SUBSTANCES = ("cannabis", "marijuana", "thc", "cocaine", "opioid", "heroin", "fentanyl", "stimulant", "methamphetamine", "amphetamine", "mdma", "ecstasy", "benzodiazepine", "kratom", "ketamine", "lsd", "psilocybin", "inhalant")
AGES = ((2, "infant (<2)"), (12, "child (2-11)"), (18, "adolescent (12-17)"), (65, "adult (18-64)"), (80, "older adult (65-79)"))
BODIES = ((18.5, "underweight"), (25, "normal"), (30, "overweight"), (35, "obese class I"), (40, "obese class II"))
GIVEN = r"(\d+(?:\.\d+)?)"


def cell(c: Column) -> Column:
    """The trimmed cell, null where it is blank."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(list(BLANK)), t)


def is_negative(c: Column) -> Column:
    return cell(c).isNull() | c.rlike(NEGATIVE)


def first_number(c: Column, pattern: str) -> Column:
    """The first group of the pattern as a number, in any case."""
    return F.nullif(F.regexp_extract(c, f"(?i){pattern}", 1), F.lit("")).try_cast("double")


def pick(low: Column, table: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """The name of the first pattern that is found in the (lower-case) text."""
    out = F.lit(None).cast("string") if default is None else default
    for name, pattern in reversed(table):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def every(low: Column, table: Sequence[tuple[str, str]], also: Mapping[str, Column] | None = None) -> Column:
    """All names whose pattern is found, or whose condition in `also` holds, in the table's order."""
    also = also or {}
    return F.array_compact(F.array(*(F.when(low.rlike(p) | F.coalesce(also.get(n, F.lit(False)), F.lit(False)), n) for n, p in table)))


def dose(c: Column) -> Column:
    """struct(amount, unit) of the first dose: mass in mg, other units as they are."""
    found = r"(\d+(?:\.\d+)?)\s*(mcg|µg|ug|mg|g|units?|iu|m?l)\b"
    unit = F.nullif(F.lower(F.regexp_extract(c, f"(?i){found}", 2)), F.lit(""))
    mass = F.create_map(*(F.lit(x) for pair in MG for x in pair))
    factor = F.element_at(mass, unit)
    return F.struct((first_number(c, found) * F.coalesce(factor, F.lit(1.0))).alias("amount"), F.when(factor.isNotNull(), F.lit("mg")).otherwise(unit).alias("unit"))


def per_kilo(c: Column) -> Column:
    """Milligrams for each kilogram of an order by weight."""
    found = r"(\d+(?:\.\d+)?)\s*(mcg|µg|ug|mg|g)\s*/\s*kg"
    mass = F.create_map(*(F.lit(x) for pair in MG for x in pair))
    return first_number(c, found) * F.element_at(mass, F.lower(F.regexp_extract(c, f"(?i){found}", 2)))


def dose_mg(c: Column, weight: Column | None = None) -> Column:
    """Milligrams of one dose; per-kilogram doses are multiplied by the weight."""
    by_weight = per_kilo(c) * (weight if weight is not None else F.lit(None).cast("double"))
    return F.when(per_kilo(c).isNotNull(), F.round(by_weight, 3)).when(dose(c)["unit"] == "mg", dose(c)["amount"])


def per_day(c: Column) -> Column:
    """Doses a day: a phrase, every N hours, or once; null for none of them."""
    low = F.lower(c)
    hours = first_number(low, r"\b(?:q|every)\s*(\d{1,2})\s*(?:h\b|hours?|hrs?\b|hourly)")
    out = F.when(hours > 0, 24 / hours).when(low.rlike(r"single dose|one[- ]time|\bonce\b|\bstat\b|single administration"), 1.0)
    for pattern, n in reversed(PER_DAY):
        out = F.when(low.rlike(pattern), F.lit(n)).otherwise(out)
    return out


def as_needed(c: Column) -> Column:
    return F.lower(c).rlike(r"\bprn\b|as needed|as required|when required")


def route(c: Column) -> Column:
    return pick(F.lower(c), ROUTES)


def duration_days(c: Column) -> Column:
    days, weeks, months = (first_number(c, rf"(\d+)\s*(?:-\s*)?(?:{unit})") for unit in (r"days?|d\b", "weeks?|wks?", "months?|mos?"))
    return F.coalesce(days, weeks * 7, months * 30, first_number(c, r"(\d+)\s*(?:-\s*)?years?") * 365)


def duration_class(c: Column) -> Column:
    low, days = F.lower(c), duration_days(c)
    said = (("chronic", "chronic|ongoing|long-?term|indefinite|lifelong|maintenance|continuous"), ("prn", "as needed|prn"), ("single_dose", "single|one[- ]time|once|stat|1 dose"))
    length = F.when(days <= 14, "short_course").when(days <= 90, "intermediate_course").when(days > 90, "chronic").otherwise("unspecified")
    return F.when(cell(c).isNull(), "not_reported").otherwise(pick(low, said, length))


def renal(c: Column) -> Column:
    """Words for a status win over a clearance; a clearance over nothing."""
    low = F.lower(cell(c))
    crcl, egfr = first_number(c, r"crcl[^0-9<>]*(?:[<>]\s*)?" + GIVEN), first_number(c, r"egfr[^0-9<>]*(?:[<>]\s*)?" + GIVEN)
    value = F.coalesce(crcl, egfr)
    measured = F.when(value.isNotNull(), band(value, CLEARANCE, "normal")).otherwise("impaired (unspecified)")
    fine = is_negative(c) | low.rlike(r"(egfr|crcl)\s*>\s*90")
    status = pick(low, (KIDNEY_FAILURE, *DEGREES), F.when(fine, "normal").otherwise(measured))
    return F.struct(F.when(low.isNull(), "not reported").otherwise(status).alias("status"), crcl.alias("crcl"), egfr.alias("egfr"))


def hepatic(c: Column) -> Column:
    """A Child-Pugh class says the status as the words do."""
    low = F.lower(cell(c))
    grade = F.nullif(F.upper(F.regexp_extract(c, r"(?i)child[- ]?pugh\s*(?:class\s*)?([abc])\b", 1)), F.lit(""))
    worst = F.when((grade == "C") | low.rlike(r"\bsevere\b|decompensated"), "severe").when((grade == "B") | low.rlike(r"\bmoderate\b"), "moderate")
    mild = worst.when((grade == "A") | low.rlike(r"\bmild\b|elevated (lfts|alt|ast)|fatty liver|nafld|steatosis"), "mild")
    status = mild.when(low.rlike("cirrhosis|hepatitis"), "impaired (unspecified)").when(is_negative(c) | low.rlike("normal"), "normal").otherwise("impaired (unspecified)")
    return F.struct(F.when(low.isNull(), "not reported").otherwise(status).alias("status"), grade.alias("child_pugh"))


def cardiac(c: Column) -> Column:
    low = F.coalesce(F.lower(cell(c)), F.lit(""))
    qtc, ef = first_number(c, r"qtc\s*[<>]?\s*(\d{3})"), first_number(c, r"\b(?:lv)?ef\s*[<>]?\s*(\d{2})\s*%?")
    flags = every(low, HEART, {"heart failure / reduced EF": ef < LOW_EF, "QT prolongation": qtc >= LONG_QTC})
    pressure = F.nullif(F.regexp_replace(F.regexp_extract(c, r"\b(\d{2,3}\s*/\s*\d{2,3})\b", 1), r"\s", ""), F.lit(""))
    return F.struct((~is_negative(c)).alias("present"), flags.alias("flags"), qtc.alias("qtc"), ef.alias("ef"), pressure.alias("bp"))


def respiratory(c: Column) -> Column:
    low = F.coalesce(F.lower(cell(c)), F.lit(""))
    flags = every(low, LUNG)
    flags = F.when((F.size(flags) == 0) & low.contains("rhinitis"), F.array(F.lit("rhinitis only"))).otherwise(flags)
    return F.struct((~is_negative(c)).alias("present"), flags.alias("flags"), low.rlike("severe|oxygen|o2 dependent|hypox").alias("severe"))


def pregnancy(c: Column, sex: Column | None = None) -> Column:
    low = F.lower(cell(c))
    weeks = first_number(low, r"(\d{1,2})\s*weeks?")
    named = pick(low, (("1", r"(1st|first)\s*trimester"), ("2", r"(2nd|second)\s*trimester"), ("3", r"(3rd|third)\s*trimester"))).cast("int")
    absent = F.when(F.lower(sex).startswith("m"), "not_applicable").otherwise("not_reported") if sex is not None else F.lit("not_reported")
    status = (
        F.when(low.isNull(), absent)
        .when(low.rlike(r"\bpregnant\b") & ~low.rlike("not pregnant|non-?pregnant"), "pregnant")
        .when(low.rlike("breast-?feed|lactat|nursing") & ~low.rlike("not breast|not lactat|no longer"), "breastfeeding")
        .when(low.rlike("trying to conceive|planning pregnancy"), "planning_pregnancy")
        .otherwise("not_applicable")
    )
    return F.struct(status.alias("status"), F.coalesce(named, F.when(weeks < 14, 1).when(weeks < 28, 2).when(weeks >= 28, 3)).alias("trimester"), weeks.alias("weeks"))


def allergies(c: Column) -> Column:
    """The listed allergies; none where the field says so."""
    return F.when(is_negative(c) | F.lower(c).rlike("nkda|no known"), F.array().cast("array<string>")).otherwise(split_list(c))


def listed(c: Column) -> Column:
    return F.when(is_negative(c), F.array().cast("array<string>")).otherwise(split_list(c))


def _habit(c: Column, table: Sequence[tuple[str, Column]], last: str) -> Column:
    """The first level whose condition holds."""
    out = F.when(cell(c).isNull(), "not_reported")
    for name, condition in table:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(last)


def tobacco(c: Column) -> Column:
    low = F.lower(cell(c))
    has = lambda p: low.rlike(p)
    level = _habit(c, (("former", has("former|quit|ex-?smoker|stopped")), ("never", has(r"never|non-?smoker|^no\b|none|lifetime")), ("current_light", has("occasional|social|light")), ("current", has("current|smokes|smoker|pack|cigarette|vape|vaping|chew|snus|ppd"))), "unclear")
    return F.struct(level.alias("level"), first_number(c, GIVEN + r"\s*(?:ppd|packs?\s*(?:per|/|a)\s*day)").alias("packs"), first_number(c, r"(\d+)\s*(?:cigarettes?|cigs?)\s*(?:per|/|a)\s*day").alias("cigarettes"))


def alcohol(c: Column) -> Column:
    low = F.lower(cell(c))
    drinks = GIVEN + r"\s*(?:drinks?|beers?|glass(?:es)?|units?)?\s*(?:per|/|a)\s*"
    week = F.coalesce(first_number(c, drinks + "week"), first_number(c, drinks + "(?:day|night|evening)") * 7)
    has = lambda p: low.rlike(p)
    level = _habit(c, (
        ("former", has("former|sober|abstinent|recovery|remission|quit")), ("heavy", has("heavy|binge|daily|alcohol use disorder|dependence|excess") | F.coalesce(week >= 14, F.lit(False))),
        ("moderate", has("moderate") | F.coalesce(week >= 7, F.lit(False))), ("light", has("rare|occasional|social|light|minimal|infrequent") | week.isNotNull()), ("none", has(r"^(never|no\b|none|abstain|teetotal|nil)")),
    ), "unclear")
    return F.struct(level.alias("level"), week.alias("per_week"))


def substances(c: Column) -> Column:
    low = F.coalesce(F.lower(cell(c)), F.lit(""))
    found = F.array_compact(F.array(*(F.when(low.contains(x), x) for x in sorted(SUBSTANCES))))
    level = _habit(c, (("former", low.rlike("former|abstinent|remission|recovery|quit|none currently|no longer")), ("none", low.rlike(r"^no\b|none|denies|never")), ("current", (F.size(found) > 0) | low.rlike("occasional|recreational|current|uses|daily|weekly"))), "unclear")
    return F.struct(level.alias("level"), found.alias("found"))


def caffeine(c: Column) -> Column:
    """Of a range of cups the upper end counts; an energy drink makes the intake high."""
    low = F.lower(cell(c))
    cups = F.coalesce(first_number(c, r"\d+\s*-\s*(\d+)\s*(?:cups?|coffees?)"), first_number(c, r"(\d+)(?:\s*-\s*\d+)?\s*(?:cups?|coffees?|teas?|shots?|espressos?|cans?)"))
    energy = F.coalesce(low.rlike("energy drink|red bull|monster|pre-?workout"), F.lit(False))
    at = lambda condition: F.coalesce(condition, F.lit(False))
    level = _habit(c, (("high", low.rlike("high|heavy|excess|large") | at(cups >= 4) | energy), ("moderate", low.rlike("moderate") | at(cups >= 2)), ("low", low.rlike(r"low|none|^no\b|minimal|rare|occasional|avoids|decaf") | at(cups <= 1))), "unclear")
    return F.struct(level.alias("level"), cups.alias("cups"), energy.alias("energy"))


def bmi(weight: Column, height_cm: Column) -> Column:
    return weight / F.pow(height_cm / 100, F.lit(2))


def age_band(c: Column) -> Column:
    return F.coalesce(band(c, AGES, "very elderly (>=80)"), F.lit("unknown"))


def bmi_class(c: Column) -> Column:
    return F.coalesce(band(c, BODIES, "obese class III"), F.lit("unknown"))


def prescription(order: Column, duration: Column, weight: Column, drug: Column | None = None) -> Column:
    """One order: amount of a dose and its unit, doses a day, daily milligrams, route (of the order, else of the drug)."""
    said = cell(order)
    amount = F.when(per_kilo(said).isNotNull(), F.round(per_kilo(said) * weight, 3)).otherwise(dose(said)["amount"])
    unit = F.when(per_kilo(said).isNotNull(), F.lit("mg")).otherwise(dose(said)["unit"])
    daily = F.when(unit == "mg", F.round(amount * per_day(said), 3))
    target = first_number(said, r"(?:titrat\w*|increas\w*|escalat\w*|up)\s*(?:to|toward)?\s*(?:a\s*)?(?:max(?:imum)?\s*(?:of)?\s*)?" + GIVEN + r"\s*mg")
    return F.struct(
        amount.alias("dose"), unit.alias("unit"), per_day(said).alias("per_day"), daily.alias("daily_mg"), F.round(daily / weight, 4).alias("mg_per_kg_day"), per_kilo(said).isNotNull().alias("weight_based"),
        target.alias("titration_mg"), F.coalesce(as_needed(said), F.lit(False)).alias("as_needed"), F.coalesce(route(said), route(drug) if drug is not None else F.lit(None).cast("string")).alias("route"), duration_class(duration).alias("duration"),
    )


def number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def patient(fields: Mapping[str, Column]) -> Column:
    """The constraint vector of a profile. fields: age, sex, weight, height, bmi and the text fields by the names used below;
    what is missing counts as blank. A missing BMI is worked out."""
    get = lambda k: fields.get(k, F.lit(None).cast("string"))
    weight, height = number(get("weight")), number(get("height"))
    mass = F.coalesce(number(get("bmi")), F.when((weight > 0) & (height > 0), F.round(bmi(weight, height), 1)))
    return F.struct(
        number(get("age")).alias("age"), age_band(number(get("age"))).alias("age_band"), cell(get("sex")).alias("sex"), weight.alias("weight"), height.alias("height"), mass.alias("bmi"), bmi_class(mass).alias("bmi_class"),
        renal(get("renal")).alias("renal"), hepatic(get("hepatic")).alias("hepatic"), cardiac(get("cardiac")).alias("cardiac"), respiratory(get("respiratory")).alias("respiratory"), pregnancy(get("pregnancy"), get("sex")).alias("pregnancy"),
        allergies(get("allergies")).alias("allergies"), *(listed(get(k)).alias(k) for k in ("genetic", "chronic", "medications", "foods")), tobacco(get("tobacco")).alias("tobacco"), alcohol(get("alcohol")).alias("alcohol"),
        substances(get("substance")).alias("substance"), caffeine(get("caffeine")).alias("caffeine"), cell(get("symptoms")).alias("symptoms"),
    )


def context(fields: Mapping[str, Column]) -> Column:
    """Profile and prescription of a row, the latter with the former's weight."""
    p = patient(fields)
    get = lambda k: fields.get(k, F.lit(None).cast("string"))
    return F.struct(p.alias("patient"), prescription(get("dosage"), get("duration"), number(get("weight")), get("drug")).alias("prescription"))


#: Builders of context blocks by name: callers add their own, each a function of the fields.
PRIMITIVES = {"patient": patient, "prescription": lambda f: context(f)["prescription"]}


def blocks(fields: Mapping[str, Column], names: Sequence[str], registry: Mapping = PRIMITIVES) -> Column:
    """A struct of the named blocks; a name that isn't registered is an error."""
    return F.struct(*(registry[n](fields).alias(n) for n in names))


def coerced(c: Column, schema: str, lists: Sequence[str] = ()) -> Column:
    """struct(block, note) of JSON text held against a schema ("name type, ..."): unknown keys go, missing ones are null
    (or empty lists) and are counted in the note; `parse_failed` where it is no object."""
    keys = [x.split()[0] for x in schema.split(", ")]
    parsed, has = F.from_json(c, schema), F.json_object_keys(c)
    fields = [F.when(parsed.isNotNull(), F.coalesce(parsed[k], F.array().cast(dict(x.split(" ", 1) for x in schema.split(", "))[k]))) if k in lists else parsed[k] for k in keys]
    missing = F.size(F.array_except(F.array(*map(F.lit, keys)), has))
    block = F.when(has.isNotNull(), F.struct(*(f.alias(k) for f, k in zip(fields, keys))))
    return F.struct(block.alias("block"), F.when(has.isNull(), "parse_failed").when(missing == 0, "ok").otherwise(F.concat(F.lit("missing_keys:"), missing.cast("string"))).alias("note"))
