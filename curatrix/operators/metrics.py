"""Binary and multi-label metrics, all from additive counts, so one aggregation serves every metric and every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, zero: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(a / b)


def confusion(df: DataFrame, gold: Column, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn (true is the positive class) by group."""
    marked = df.select(*by, gold.alias("_g"), predicted.alias("_p"))
    return marked.groupBy(*by).agg(*(F.count_if((F.col("_g") == g) & (F.col("_p") == p)).alias(n) for n, g, p in (("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False))))


def rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Adds accuracy, precision, recall, f1, fpr, fnr, npv, balanced accuracy, macro f1, mcc and kappa."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1, f1n = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    made = {
        "accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": recall, "f1": f1, "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "npv": ratio(tn, tn + fn),
        "balanced_accuracy": (recall + specificity) / 2, "macro_f1": (f1 + f1n) / 2,
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "kappa": ratio(ratio(tp + tn, n) - chance, 1 - chance),
    }
    return counts.select("*", *(F.round(v, digits).alias(k) for k, v in made.items()))


def policies(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Accuracy when an unparsed answer (null) counts as negative, as positive, as wrong, or not at all; one pass."""
    m = df.select(gold.alias("g"), predicted.alias("p"))
    hit = lambda p: F.avg((F.col("g") == p).cast("double"))
    return m.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").isNull()).alias("n_unparsed"),
        F.round(hit(F.coalesce("p", F.lit(False))), 6).alias("fail_open"), F.round(hit(F.coalesce("p", F.lit(True))), 6).alias("fail_closed"),
        F.round(hit(F.coalesce("p", ~F.col("g"))), 6).alias("always_wrong"), F.round(hit(F.col("p")), 6).alias("abstain"),
    )


def ranking(df: DataFrame, gold: Column, score: Column) -> DataFrame:
    """auroc (ties count half) and average precision over distinct thresholds.

    Rows are first added up by score, and the running sums are made by ranges of the score.
    """
    from curatrix.operators.joins import running

    by = df.select(gold.cast("long").alias("g"), score.alias("s")).groupBy("s").agg(F.sum("g").alias("pos"), F.sum(1 - F.col("g")).alias("neg"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cum = running(by, "s", ["pos", "neg"], parts, descending=True).select("pos", "neg", F.col("upto_pos").alias("tp"), F.col("upto_neg").alias("fp"))
    all_ = cum.agg(F.max("tp").alias("np"), F.max("fp").alias("nn"), F.sum(F.col("pos") * (F.lit(0.0) + F.col("fp") - F.col("neg") / 2)).alias("above"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return all_.select(F.round(1 - F.col("above") / (F.col("np") * F.col("nn")), 6).alias("auroc"), F.round(F.col("ap") / F.col("np"), 6).alias("average_precision"))


def long_form(df: DataFrame, key: str, names: Sequence[str], gold: Column, predicted: Column) -> DataFrame:
    """key, category, g, p from two arrays of booleans."""
    zipped = F.transform(F.arrays_zip(gold.alias("g"), predicted.alias("p")), lambda x, i: F.struct(F.get(F.array(*(F.lit(n) for n in names)), i).alias("category"), x["g"].alias("g"), x["p"].alias("p")))
    return df.select(key, F.explode(zipped).alias("x")).select(key, "x.*")


def multilabel(flags: DataFrame, key: str) -> DataFrame:
    """Subset accuracy, Hamming loss, micro and macro F1 (macro over categories with gold), samples F1 and Jaccard."""
    rows = flags.groupBy(key).agg(F.count_if(F.col("g") & F.col("p")).alias("both"), F.count_if("g").alias("ng"), F.count_if("p").alias("np"), F.count(F.lit(1)).alias("k"))
    union = F.col("ng") + F.col("np") - F.col("both")
    by_row = rows.agg(
        F.round(F.avg((union == F.col("both")).cast("double")), 6).alias("subset_accuracy"), F.round(F.sum(union - F.col("both")) / F.sum("k"), 6).alias("hamming_loss"),
        F.round(F.avg(ratio(2.0 * F.col("both"), F.col("ng") + F.col("np"), 1.0)), 6).alias("samples_f1"), F.round(F.avg(ratio(F.col("both") * 1.0, union, 1.0)), 6).alias("samples_jaccard"),
        F.round(ratio(2.0 * F.sum("both"), F.sum("ng") + F.sum("np")), 6).alias("micro_f1"),
    )
    cats = confusion(flags, F.col("g"), F.col("p"), "category").where("tp + fn > 0")
    macro = cats.agg(F.round(F.avg(ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))), 6).alias("macro_f1"))
    return by_row.join(F.broadcast(macro))


def more_rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Adds both classes' precision, recall and F1, and the F1 weighted by support."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    f1, f1n = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    made = {"precision_neg": ratio(tn, tn + fn), "recall_neg": ratio(tn, tn + fp), "f1_neg": f1n, "weighted_f1": ratio(f1 * (tp + fn) + f1n * (tn + fp), tp + fp + fn + tn)}
    return counts.select("*", *(F.round(v, digits).alias(k) for k, v in made.items()))


def multilabel_averages(flags: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1: micro, macro (over categories with gold), weighted by support, and by row; and exact matches."""
    cats = confusion(flags, F.col("g"), F.col("p"), "category")
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r, f = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)
    gold = F.when(tp + fn > 0, 1.0)
    mean = lambda x, w: F.round(F.sum(w * x) / F.sum(w), 6)
    by_cat = cats.agg(
        F.round(ratio(F.sum(tp), F.sum(tp + fp)), 6).alias("micro_precision"), F.round(ratio(F.sum(tp), F.sum(tp + fn)), 6).alias("micro_recall"),
        *(mean(x, gold).alias(f"macro_{n}") for n, x in (("precision", p), ("recall", r), ("f1", f))), *(mean(x, tp + fn).alias(f"weighted_{n}") for n, x in (("precision", p), ("recall", r), ("f1", f))),
    )
    rows = flags.groupBy(key).agg(F.count_if(F.col("g") & F.col("p")).alias("both"), F.count_if("g").alias("ng"), F.count_if("p").alias("np"))
    by_row = rows.agg(F.round(F.avg(ratio(F.col("both") * 1.0, F.col("np"))), 6).alias("samples_precision"), F.round(F.avg(ratio(F.col("both") * 1.0, F.col("ng"))), 6).alias("samples_recall"), F.count_if((F.col("both") == F.col("ng")) & (F.col("both") == F.col("np"))).alias("n_exact"))
    return by_cat.join(F.broadcast(by_row))


#: Metrics of additive confusion counts by name; callers add theirs, each a column of tp, fp, fn, tn.
METRICS = {
    "accuracy": lambda tp, fp, fn, tn: ratio(tp + tn, tp + fp + fn + tn), "recall": lambda tp, fp, fn, tn: ratio(tp, tp + fn), "fpr": lambda tp, fp, fn, tn: ratio(fp, fp + tn),
    "f1": lambda tp, fp, fn, tn: ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": lambda tp, fp, fn, tn: (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
}


def resampled(counts: DataFrame, draws: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """Bootstrap samples of confusion counts: tp, fp, fn, tn of each resample b (and group).

    Rows with one outcome are alike, so a draw is a number below n that falls among tp, fp, fn or tn: no row is numbered
    or joined, and the draws (draws x n numbers) are added up where they are made.
    """
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    each = counts.select(*by, "tp", "fp", "fn", "tn", n.alias("n")).where("n > 0").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    hit = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in by), F.col("b").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("n"))
    drawn = each.withColumn("i", hit)
    tp, fp, fn = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn")
    i = F.col("i")
    return drawn.groupBy(*by, "b").agg(F.count_if(i < tp).alias("tp"), F.count_if((i >= tp) & (i < fp)).alias("fp"), F.count_if((i >= fp) & (i < fn)).alias("fn"), F.count_if(i >= fn).alias("tn"))


def intervals(samples: DataFrame, names: Sequence[str], by: Sequence[str] = (), registry=None) -> DataFrame:
    """metric, low, high (2.5 % and 97.5 %, linear) of bootstrap samples of confusion counts."""
    registry = registry or METRICS
    counts = [F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")]
    each = samples.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), registry[m](*counts).alias("x")) for m in names))).alias("m")).select(*by, "m.*")
    return each.groupBy(*by, "metric").agg(F.round(F.percentile("x", 0.025), 6).alias("low"), F.round(F.percentile("x", 0.975), 6).alias("high"))
