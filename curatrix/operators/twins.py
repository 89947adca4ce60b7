"""Safe twins of rows that carry a single risk: the risk's own fields get a neutral value, every other mention of it
goes, and label, role and prompt follow. Words, neutral values and absence sentences are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import split_items

# What a swept profile field becomes when nothing of it is left.
SWEPT = {
    "Chronic Conditions": "",
    "Symptoms": "None",
    "Genetic Disorders": "",
    "Current Medications": "None",
    "Foods (Last 24h)": "Regular balanced meals",
    "Drug Allergies": "None known",
    "Renal Impairment": "None",
    "Hepatic Impairment": "None",
    "Cardiac Impairment": "None",
    "Respiratory Impairment": "None",
    "Alcohol Use": "None",
    "Tobacco Use": "Never",
    "Substance Use": "None",
    "Caffeine Intake": "",
}
# The neutral value of a risk's own fields.
NEUTRAL = {
    "Allergy & Adverse Drug Reaction Risk": {"Drug Allergies": "None known"},
    "Drug-Food Interaction Risk": {"Foods (Last 24h)": "Regular balanced meals; no grapefruit"},
    "Renal Impairment Risk": {"Renal Impairment": "Normal renal function (eGFR >90 mL/min, CrCl 105 mL/min)"},
    "Hepatic Impairment Risk": {"Hepatic Impairment": "Normal hepatic function (LFTs within normal limits)"},
    "Cardiac Impairment Risk": {"Cardiac Impairment": "No known cardiac disease; ECG normal (QTc 410 ms)"},
    "Respiratory Impairment Risk": {"Respiratory Impairment": "No respiratory disease; normal spirometry"},
    "Pregnancy & Breastfeeding Risk": {"Pregnancy / Breastfeeding": "Not pregnant, not breastfeeding"},
    "Alcohol Use Risk": {"Alcohol Use": "None (lifelong abstainer)"},
    "Tobacco Use Risk": {"Tobacco Use": "Never smoker"},
    "Substance Use Risk": {"Substance Use": "None"},
    "Caffeine Intake Risk": {"Caffeine Intake": "Low (1 cup of coffee per day)"},
    "Age Risk": {"Age (year)": "48"},
}


def mentions(c: Column, words: Column) -> Column:
    """Whether a text holds one of the words, in any case."""
    return F.exists(words, lambda w: F.contains(F.lower(c), F.lower(w)))


def sweep(c: Column, words: Column, empty: Column) -> Column:
    """The list without items that hold a word; `empty` where nothing is left; the very text where no word occurs."""
    kept = F.array_join(F.filter(split_items(c), lambda x: ~mentions(x, words)), "; ")
    return F.when(F.coalesce(mentions(c, words), F.lit(False)), F.coalesce(F.nullif(kept, F.lit("")), empty)).otherwise(c)


def clause(c: Column, words: Column, separators: Sequence[str] = (" due to ", " with ", " secondary to ")) -> Column:
    """The text if it holds no word; else its first clause around a separator that has two letters and none; else ''."""
    sides = F.flatten(F.array(*(F.transform(F.split(c, f"(?i){s}", 2), lambda x: F.trim(x)) for s in separators)))
    clean = F.filter(sides, lambda x: ~mentions(x, words) & x.rlike("[A-Za-z].*[A-Za-z]"))
    return F.when(F.coalesce(mentions(c, words), F.lit(False)), F.coalesce(F.get(clean, F.lit(0)), F.lit(""))).otherwise(c)


def make(df: DataFrame, key: str, risk: str, words: Mapping[str, Sequence[str]], neutral: Mapping[str, Mapping[str, str]] = NEUTRAL, swept: Mapping[str, str] = SWEPT, clauses: Sequence[str] = (), extra: Mapping[str, Column] | None = None) -> DataFrame:
    """df's columns of the twin: its key has the suffix c. Rows whose risk is in neither table give no twin. `extra`
    replaces further columns (a dose, a prompt) by expressions over the original row."""
    table = F.create_map(*(x for k, ws in words.items() for x in (F.lit(k), F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>"))))
    out = []
    for c in df.columns:
        new = F.col(f"`{c}`")
        if c == key:
            new = F.concat(new.cast("string"), F.lit("c"))
        elif extra and c in extra:
            new = extra[c]
        else:
            if c in swept:
                new = sweep(new, F.col("_w"), F.lit(swept[c]))
            elif c in clauses:
                new = clause(new, F.col("_w"))
            for name, fields in neutral.items():
                if c in fields:
                    new = F.when(F.col(risk) == name, F.lit(fields[c])).otherwise(new)
        out.append(new.alias(c))
    known = [*words, *(k for k in neutral if k not in words)]
    return df.where(F.col(risk).isin(known)).withColumn("_w", F.coalesce(F.element_at(table, F.col(risk)), F.array().cast("array<string>"))).select(*out)


def interleave(df: DataFrame, twins: DataFrame, key: str, risk: str) -> DataFrame:
    """Originals that have a twin, and the twins: Sample_Role, Source_Key, True_Risk, Omitted_Risk; sort by Source_Key and
    Sample_Role (descending) to see them in turn."""
    base = df.withColumn(key, F.col(key).cast("string"))
    had = twins.select(F.regexp_replace(key, "c$", "").alias(key))
    mark = lambda d, role, source, true, omitted: d.select("*", F.lit(role).alias("Sample_Role"), source.alias("Source_Key"), true.alias("True_Risk"), omitted.alias("Omitted_Risk"))
    kept = mark(base.join(had, key, "left_semi"), "original", F.col(key), F.col(risk), F.lit(None).cast("string"))
    return kept.unionByName(mark(twins, "counterfactual", F.regexp_replace(key, "c$", ""), F.lit(None).cast("string"), F.col(risk)))


def prompt(age: Column, gender: Column, diagnosis: Column, drug: Column, dose: Column, absence: Column) -> Column:
    what = F.when(F.coalesce(dose, F.lit("")) != "", F.concat(drug, F.lit(" ("), dose, F.lit(")"))).otherwise(drug)
    who = F.concat(F.coalesce(F.round(age.try_cast("double")).cast("int").cast("string"), age), F.lit("-year-old "), gender)
    having = F.when(F.coalesce(diagnosis, F.lit("")) != "", F.concat(F.lit(" with "), diagnosis)).otherwise("")
    return F.concat(who, having, F.lit(" is prescribed "), what, F.lit(". "), absence, F.lit(" Is this safe?"))
