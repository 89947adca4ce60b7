"""Training records: answers, stored context, targets, withheld blocks, audit pairs, rewards and mined groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import audit, semi, text
from curatrix.operators import joins
from curatrix.operators.generated import pretty

# The weights of the reward's terms, the budget of tokens, and the share of category credit under a wrong
# verdict.
WEIGHTS = {"verdict": 0.5, "decisive": 1.5, "others": 0.5, "schema": 0.2, "length": 0.05, "bonus": 0.3, "consistency": 0.3, "missed": 1.0, "blocked": 0.0, "extra": 0.3, "unparsed": -1.0, "gate": 0.25, "tokens": 1200}


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets; two empty ones agree."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * both / F.greatest(F.lit(1), F.size(a) + F.size(b)))


def reward(parsed: Column, safe: Column, gold_safe: Column, said: Column, gold: Column, decisive: Column, complete: Column, chars: Column, targets: Sequence[str] = (), weights: Mapping[str, float] = WEIGHTS) -> Column:
    """struct of the terms and their total. said and gold are sets of category names; decisive may be null.

    An answer that doesn't parse gets one penalty and nothing else. Credit for categories shrinks under a wrong verdict.
    Without a decisive category its term goes by the F1 of the whole sets.
    """
    w, right = weights, safe == gold_safe
    gate = F.when(right, 1.0).otherwise(w["gate"])
    known = decisive.isNotNull()
    hit = F.array_contains(said, decisive) == F.array_contains(gold, decisive)
    without = lambda s: F.filter(s, lambda x: x != decisive)
    over = (text.approx_tokens_of(chars) - w["tokens"]) / w["tokens"]
    terms = {
        "verdict": F.when(right, w["verdict"]).otherwise(0.0), "decisive": gate * w["decisive"] * F.when(known, hit.cast("double")).otherwise(set_f1(said, gold)), "bonus": F.when(known & hit & right & decisive.isin(*targets or [""]), w["bonus"]).otherwise(0.0),
        "others": F.when(known, gate * w["others"] * set_f1(without(said), without(gold))).otherwise(0.0), "schema": F.when(complete, w["schema"]).otherwise(0.0), "length": F.when(over > 0, -w["length"] * F.least(over, F.lit(2.0))).otherwise(0.0),
        "consistency": F.when(complete & (safe != (F.size(said) == 0)), -w["consistency"]).otherwise(0.0), "missed": F.when(~gold_safe & safe, -w["missed"]).otherwise(0.0), "blocked": F.when(gold_safe & ~safe, -w["blocked"]).otherwise(0.0),
        "extra": -w["extra"] * F.size(F.array_except(said, gold)),
    }
    value = lambda c, bad: F.when(parsed, F.round(c, 9)).otherwise(F.lit(bad)).cast("double")
    return F.struct(*(value(c, 0.0).alias(k) for k, c in terms.items()), value(sum(terms.values()), w["unparsed"]).alias("total"))


def ceiling(decisive: Column, targets: Sequence[str] = (), weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The most that a reward can be for a scenario."""
    w = weights
    full = F.lit(w["verdict"] + w["decisive"] + w["others"] + w["schema"])
    return F.round(F.when(decisive.isNull(), w["verdict"] + w["decisive"] + w["schema"]).when(decisive.isin(*targets or [""]), full + w["bonus"]).otherwise(full), 9)


def mined(samples: DataFrame, key: str, order: str, value: str, hard: float, unstable: float) -> DataFrame:
    """Per scenario: n, mean, variance and range of its samples' rewards, added up in the samples' order, and why it is kept
    (null: it isn't)."""
    v = F.col(value)
    g = joins.in_order(samples, [key], [order, value], {"n": F.count(F.lit(1)), "_mean": F.avg(v), "_variance": F.var_pop(v), "_most": F.max(v), "_least": F.min(v)})
    gap = F.col("_most") - F.col("_least")
    # As databases round: means of few samples are often exact halves, and a digit lost below one would round it down.
    six = lambda c: F.round(c * 1e6) / 1e6
    reason = F.when(F.col("n") < 2, None).when(gap < 1e-6, None).when(F.col("_mean") < hard, "hard").when(F.col("_variance") > unstable, "unstable")
    return g.select(key, "n", six(F.col("_mean")).alias("mean"), six(F.col("_variance")).alias("variance"), six(gap).alias("gap"), reason.alias("reason"))


def with_reference(samples: DataFrame, key: str, order: str, value: str, wrong: Column) -> DataFrame:
    """`replaced`: the sample of lowest reward (the first of equal ones) of every group whose samples are all wrong and
    score alike: the reference answer takes its place."""
    by = samples.groupBy(key).agg(F.min(wrong.cast("int")).alias("_w"), (F.max(value) - F.min(value)).alias("_g"), F.min_by(order, F.struct(F.col(value), F.col(order))).alias("_o"))
    return samples.join(by, key).withColumn("replaced", (F.col("_w") == 1) & (F.col("_g") < 1e-6) & (F.col(order) == F.col("_o"))).drop("_w", "_g", "_o")


def scenario(labels: Column, answer: Column, names: Sequence[str]) -> Column:
    """struct(safe, gold, decisive, source): labels from their own column, else from the answer's JSON; the decisive category
    is the only true one."""
    own, said = semi.categories(semi.json_map(labels), names), semi.categories(semi.json_map(semi.braces(answer)), names)
    has = lambda c: c["ok"] & (c["n"] > 0)
    flags = F.when(has(own), own["flags"]).when(has(said), said["flags"])
    gold = F.filter(F.zip_with(F.array(*map(F.lit, names)), flags, lambda n, f: F.when(f, n)), lambda x: x.isNotNull())
    return F.struct((F.size(gold) == 0).alias("safe"), gold.alias("gold"), F.when(F.size(gold) == 1, F.get(gold, F.lit(0))).alias("decisive"), F.when(has(own), "labels").when(has(said), "answer").otherwise("none").alias("source"))


def answer(teacher: Column, student: Column, safe: Column, flags: Column, names: Sequence[str]) -> Column:
    """The assistant's turn: the teacher's reasoning where there is one, else the student's."""
    return pretty(safe, flags, names, F.coalesce(F.nullif(F.trim(teacher), F.lit("")), F.trim(student), F.lit("")))


def json_to_guard(c: Column, names: Sequence[str]) -> Column:
    """An answer in JSON as guard text: the verdict line and the codes of its true categories."""
    found = semi.categories(semi.json_map(semi.braces(c)), names)
    return F.when(found["ok"] & (found["n"] > 0), semi.to_guard(~F.exists(found["flags"], lambda x: x), found["flags"]))


def guard_to_json(c: Column, names: Sequence[str], reasoning: Column) -> Column:
    """Guard text as an answer in JSON."""
    g = semi.guard_codes(c, names)
    return F.when(g["safe"].isNotNull(), pretty(g["safe"], F.array(*(F.array_contains(g["names"], n) for n in names)), names, reasoning))


def kept_blocks(stored: Column, names: Sequence[str], again: Mapping[str, Column]) -> Column:
    """The named blocks of a stored context (JSON object of texts), in their order; a missing one is worked out again."""
    m = F.from_json(stored, "map<string,string>")
    return F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("key"), F.coalesce(F.element_at(m, n), again.get(n, F.lit(None).cast("string"))).alias("value")) for n in names)))


def staged(c: Column, headers: Mapping[str, str], order: Sequence[str]) -> Column:
    """A target of stages: the sections of a text under their canonical headers in a fixed order; null if one is missing."""
    parts = audit.sections(c, headers)
    return F.when(F.forall(F.array(*map(F.lit, order)), lambda k: F.array_contains(F.map_keys(parts), k)), F.concat_ws("\n\n", *(F.concat(F.lit(f"[{k}]\n"), F.element_at(parts, k)) for k in order)))


def impersonal(message: Column) -> Column:
    """Whether a message tells nothing of a person: no profile lines, no demographics."""
    return ~message.rlike(r"(?m)^Patient profile:|^- [^:\n]+:") & (F.size(text.demographics(message)) == 0)


def withheld(df: DataFrame, key: str, blocks: Mapping[str, Column], conditions: Mapping[str, Sequence[str]]) -> DataFrame:
    """key, condition, message: each row once for each condition, with the blocks that it shows."""
    made = [F.struct(F.lit(c).alias("condition"), F.concat_ws("\n\n", *(F.concat(F.lit(f"{b}:\n"), blocks[b]) for b in shown)).alias("message")) for c, shown in conditions.items()]
    return df.select(key, F.explode(F.array(*made)).alias("x")).select(key, "x.*")


def audit_pairs(df: DataFrame, key: str, said: Column, gold: Column, names: Sequence[str], concepts: Mapping[str, Sequence[str]]) -> DataFrame:
    """A pair for every audit line of an answer: `flip` where its decision is wrong (the flipped word is chosen), `same` where
    it is right (it is rejected); with the tier of a missed category."""
    lines = audit.audit(said, names)
    each = df.select(key, said.alias("_said"), gold.alias("_gold"), F.explode(lines).alias("line"))
    right = F.array_contains("_gold", F.col("line.name")) == F.col("line.decision")
    word = lambda x: F.when(x, "True").otherwise("False")
    missed = F.array_contains("_gold", F.col("line.name")) & ~F.col("line.decision")
    return each.select(
        key, F.col("line.name").alias("name"), F.when(right, "same").otherwise("flip").alias("kind"), word(F.when(right, F.col("line.decision")).otherwise(~F.col("line.decision"))).alias("chosen"),
        word(F.when(right, ~F.col("line.decision")).otherwise(F.col("line.decision"))).alias("rejected"), F.when(missed, audit.severity_tier(F.col("_said"), F.col("line.name"), F.col("_gold"), concepts)).alias("tier"),
    )


def forced_pairs(samples: DataFrame, by: Sequence[str], kind: str, tokens: str, item: str, accepted: Column, fallback: Column) -> DataFrame:
    """The shortest accepted continuation of each kind; a flip is paired with the one of kind `same`, else the fallback."""
    best = samples.where(accepted).groupBy(*by).agg(*(F.min(F.when(F.col(kind) == k, F.struct(tokens, item)))[item].alias(k) for k in ("flip", "same")))
    return best.where("flip is not null").select(*by, F.col("flip").alias("chosen"), F.coalesce(F.col("same"), fallback).alias("rejected"))


def answer_key(df: DataFrame, block: str, key: str, columns: Sequence[str], seed: str) -> DataFrame:
    """row (from 1, by lot in its block), block, key and what the annotators must not see."""
    from curatrix.operators.draws import ranked

    return ranked(df, [block], key, seed, "row").select("row", block, key, *columns)


def prompt(df: DataFrame, key: str, hidden: Sequence[str], template: str) -> DataFrame:
    """key and a prompt with the row's visible columns as JSON; a template has one %s."""
    return df.select(key, F.format_string(template, F.to_json(F.struct(*(c for c in df.columns if c not in hidden)), {"ignoreNullFields": "false"})).alias("prompt"))


def twin_summary(twins: DataFrame, part: str, source: str, role: str) -> DataFrame:
    """By split: rows, twins, and pairs (sources that have both roles), which mirrored training uses in both directions."""
    per = twins.groupBy(part, source).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(role) == "counterfactual").alias("c"), F.count_distinct(role).alias("roles"))
    return per.groupBy(part).agg(F.sum("n").alias("n_rows"), F.sum("c").alias("n_twins"), F.count_if(F.col("roles") == 2).alias("n_pairs"), (2 * F.count_if(F.col("roles") == 2)).alias("n_mirrored"))
