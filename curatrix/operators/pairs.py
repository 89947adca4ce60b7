"""Preference pairs: negatives, directions, on-policy errors, self-play, partial misses, relabel plans and their caps.

Label vectors are arrays of booleans in the categories' order. Choices are by md5 of a seed and the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.operators.sample import dice


def coherent(safe: Column, flags: Column) -> Column:
    """safe_with_true, unsafe_no_true, or null where verdict and labels agree."""
    some = F.exists(flags, lambda x: x)
    return F.when(safe & some, "safe_with_true").when(~safe & ~some, "unsafe_no_true")


def _ranked(flags: Column, key: str, seed: str, names: Sequence[str], wanted) -> Column:
    """Positions of the flags that are `wanted`, in hash order."""
    at = F.transform(flags, lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.get(F.array(*map(F.lit, names)), i))).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(F.filter(at, lambda s: wanted(s["x"]))), lambda s: s["i"])


def negatives(df: DataFrame, key: str, flags: str, names: Sequence[str], kinds: Sequence[str], seed: str, most_false: int = 1, most_swaps: int = 1, hard: str | None = None) -> DataFrame:
    """A row for each wrong label vector: key, neg_type, changed (names joined by |), n_true, rejected, rejected_safe.

    drop_true clears each true label. add_false sets up to most_false false ones; swap moves up to most_swaps true
    labels to false ones. The _hard kinds take only false labels of the array `hard`, which says for which labels the
    row itself holds evidence.
    """
    true = _ranked(F.col(flags), key, f"{seed}-t", names, lambda x: x)
    false = _ranked(F.col(flags), key, f"{seed}-f", names, lambda x: ~x)
    nothing = F.array().cast("array<int>")
    near = F.filter(false, lambda i: F.get(F.col(hard), i)) if hard else nothing
    edit = lambda kind, off, on: F.struct(F.lit(kind).alias("kind"), off.alias("off"), on.alias("on"))
    none = F.lit(-1)

    def swaps(kind: str, to: Column) -> Column:
        n = F.least(F.lit(most_swaps), F.size("_t"))
        return F.when(F.size(to) > 0, F.transform(F.slice("_t", 1, n), lambda t, k: edit(kind, t, F.get(to, k % F.size(to)))))

    made = {
        "drop_true": lambda: F.transform("_t", lambda t: edit("drop_true", t, none)),
        "add_false": lambda: F.transform(F.slice("_f", 1, most_false), lambda f: edit("add_false", none, f)),
        "add_false_hard": lambda: F.transform(F.slice("_h", 1, most_false), lambda f: edit("add_false_hard", none, f)),
        "swap": lambda: swaps("swap", F.col("_f")),
        "swap_hard": lambda: swaps("swap_hard", F.col("_h")),
    }
    rows = df.select(key, flags, true.alias("_t"), false.alias("_f"), near.alias("_h"))
    edits = F.flatten(F.array_compact(F.array(*(made[k]() for k in kinds))))
    one = rows.select(key, flags, F.size("_t").cast("long").alias("n_true"), F.explode(edits).alias("e"))
    wrong = F.transform(flags, lambda x, i: F.when(i == F.col("e.off"), False).when(i == F.col("e.on"), True).otherwise(x))
    label = F.array(*map(F.lit, names))
    changed = F.array_join(F.transform(F.filter(F.array_sort(F.array("e.off", "e.on")), lambda i: i >= 0), lambda i: F.get(label, i)), "|")
    return one.select(key, F.col("e.kind").alias("neg_type"), changed.alias("changed"), "n_true", wrong.alias("rejected"), (~F.exists(wrong, lambda x: x)).alias("rejected_safe"))


def directed(pairs: DataFrame, key: str, original: str, twin: str, direction: str = "both") -> DataFrame:
    """Rows (key, side, prompt, chosen, rejected) from struct columns (prompt, answer): the original's prompt prefers
    its own answer (anchored), the twin's prefers the twin's (mirror)."""
    side = lambda name, own, other: F.struct(F.lit(name).alias("side"), F.col(f"{own}.prompt"), F.col(f"{own}.answer").alias("chosen"), F.col(f"{other}.answer").alias("rejected"))
    kept = {"both": (0, 1), "anchored": (0,), "mirror": (1,)}[direction]
    sides = [side("original", original, twin), side("counterfactual", twin, original)]
    return pairs.select(key, F.inline(F.array(*(sides[i] for i in kept))))


def error_tags(said: Column, gold: Column, names: Sequence[str]) -> Column:
    """FP:name and FN:name of every wrong label, in the categories' order."""
    label = F.array(*map(F.lit, names))
    return F.array_compact(F.transform(F.arrays_zip(said.alias("s"), gold.alias("g")), lambda z, i: F.when(z["s"] & ~z["g"], F.concat(F.lit("FP:"), F.get(label, i))).when(~z["s"] & z["g"], F.concat(F.lit("FN:"), F.get(label, i)))))


def self_play(samples: DataFrame, key: str, flags: str, gold: str, tokens: str, answer: str, most: int) -> DataFrame:
    """Up to `most` rejected answers a key, the shortest of each error pattern (fewest labels wrong first). The chosen
    one is the key's own shortest right answer, else null: the gold answer is then to be used (`own` false)."""
    wrong = F.size(F.filter(F.zip_with(flags, gold, lambda a, b: a != b), lambda x: x))
    seen = samples.withColumn("_w", wrong)
    short = lambda when: F.min(F.when(when, F.struct(tokens, answer)))
    pattern = seen.groupBy(key, flags, "_w").agg(F.min(F.struct(tokens, answer)).alias("_r"))
    right = seen.groupBy(key).agg(short(F.col("_w") == 0).alias("_c"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_w", f"_r.{tokens}", f"_r.{answer}"))
    worst = pattern.where("_w > 0").withColumn("rn", rank).where(F.col("rn") <= most)
    return worst.join(right, key).select(key, "rn", F.col("_w").cast("long").alias("n_wrong"), F.col(f"_c.{answer}").alias("chosen"), F.col(f"_r.{answer}").alias("rejected"), F.col("_c").isNotNull().alias("own"))


def gold_share(df: DataFrame, own: str, key: str, fraction: float, seed: str) -> DataFrame:
    """All rows with `own`, and of the others at most fraction / (1 - fraction) of their number."""
    room = df.agg(F.floor(F.count_if(own) * fraction / (1 - fraction) + 1e-9).alias("_room"))
    w = Window.partitionBy(own).orderBy(dice(key, seed), key)
    return df.withColumn("_n", F.row_number().over(w)).join(F.broadcast(room)).where(F.col(own) | (F.col("_n") <= F.col("_room"))).drop("_n", "_room")


def partial_miss(df: DataFrame, key: str, flags: str, decisive: str, names: Sequence[str]) -> DataFrame:
    """For rows with two true labels or more: each that isn't the decisive one is dropped in turn, so that the verdict
    stays. Rows without a decisive label that is true give none."""
    label = F.array(*map(F.lit, names))
    at = F.array_position(label, F.col(decisive)).cast("int") - 1
    fit = df.withColumn("_d", at).where((F.col("_d") >= 0) & F.get(F.col(flags), F.col("_d")))
    weak = F.filter(F.transform(flags, lambda x, i: F.when(x & (i != F.col("_d")), i)), lambda i: i.isNotNull())
    return fit.select(key, flags, F.explode(weak).alias("_i")).select(key, F.get(label, F.col("_i")).alias("missed"), F.transform(flags, lambda x, i: x & (i != F.col("_i"))).alias("rejected"))


def relabel_plan(df: DataFrame, key: str, flags: str, names: Sequence[str], mode: str, cap: int, seed: str) -> DataFrame:
    """Tasks to relabel with, at most `cap` for each target label: one_hot asks for a label alone (rows on which it is
    true, among others), flip1 for one label turned over."""
    label = F.array(*map(F.lit, names))
    n = F.size(F.filter(flags, lambda x: x))
    if mode == "one_hot":
        hits = F.filter(F.transform(flags, lambda x, i: F.when(x & (n > 1), i)), lambda i: i.isNotNull())
        new = F.transform(flags, lambda x, i: i == F.col("_i"))
    elif mode == "flip1":
        hits = F.sequence(F.lit(0), F.lit(len(names) - 1))
        new = F.transform(flags, lambda x, i: F.when(i == F.col("_i"), ~x).otherwise(x))
    else:
        raise ValueError(f"mode {mode} is neither one_hot nor flip1")
    tasks = df.select(key, flags, F.explode(hits).alias("_i"))
    rank = F.row_number().over(Window.partitionBy("_i").orderBy(dice(key, seed), key))
    return tasks.withColumn("rn", rank).where(F.col("rn") <= cap).select(key, F.get(label, F.col("_i")).alias("target"), "rn", new.alias("labels"))


def plan_round(pool: DataFrame, have: DataFrame, group: str, direction: str, key: str, directions: Sequence[str], total: int, seed: str, done: DataFrame | None = None, oversample: float = 1.3) -> DataFrame:
    """The next items of a curation loop: for each group, `total` shared out to the directions, less what is accepted
    (`have`: group, direction, n), times `oversample`, plus one. A direction whose pool is used up hands what it lacks
    to the others. Items of `done` (key) are not planned again."""
    left = pool if done is None else pool.join(done.select(key), key, "left_anti")
    share = [(d, total // len(directions) + (total % len(directions) if i == 0 else 0)) for i, d in enumerate(directions)]
    grid = pool.select(group).distinct().select(group, F.inline(F.array(*(F.struct(F.lit(d).alias(direction), F.lit(s).alias("share")) for d, s in share))))
    room = left.groupBy(group, direction).agg(F.count(F.lit(1)).alias("room"))
    state = grid.join(room, [group, direction], "left").join(have, [group, direction], "left").select(group, direction, F.coalesce("room", F.lit(0)).alias("room"), F.greatest(F.col("share") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("short"))
    w = Window.partitionBy(group)
    spill = F.sum(F.when(F.col("room") == 0, F.col("short")).otherwise(0)).over(w)
    need = state.withColumn("short", F.when(F.col("room") > 0, F.col("short") + spill).otherwise(0))
    n = F.when(F.col("short") > 0, F.floor(F.col("short") * oversample + 1e-9) + 1).otherwise(0)
    turn = F.row_number().over(Window.partitionBy(group, direction).orderBy(dice(key, seed), key))
    return left.withColumn("turn", turn).join(need.select(group, direction, n.alias("_n")), [group, direction]).where(F.col("turn") <= F.col("_n")).drop("_n")


def merged(parts: Sequence[tuple[str, DataFrame]], key: str, held_out: DataFrame) -> DataFrame:
    """Union of named parts: a key comes from the first part that has it, and none that is held out."""
    rows = None
    for i, (name, df) in enumerate(parts):
        one = df.withColumn("part", F.lit(name)).withColumn("_o", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).where("_n = 1").drop("_o", "_n")
    return first.join(held_out.select(key), key, "left_anti")


def flip_line(line: Column) -> Column:
    """An audit line `name: TRUE - why` with its first decision turned over, spelled like the old one."""
    pattern = r"(?i)^([^:]*:\s*)(true|false|yes|no)\b"
    word = F.regexp_extract(line, pattern, 2)
    low = F.lower(word)
    other = F.when(low == "true", "false").when(low == "false", "true").when(low == "yes", "no").otherwise("yes")
    styled = F.when(word == F.upper(word), F.upper(other)).when(word == F.initcap(word), F.initcap(other)).otherwise(other)
    head = F.regexp_extract(line, pattern, 1)
    return F.when(word == "", line).otherwise(F.concat(head, styled, F.substr(line, F.length(head) + F.length(word) + 1)))


def one_line_diff(a: Column, b: Column) -> Column:
    """Whether two texts have equally many lines and differ in exactly one."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    return (F.size(x) == F.size(y)) & (F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d)) == 1)
