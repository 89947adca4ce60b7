"""Evaluation queries: metrics, policies, agreement, resampling and audits on the driver's tables.

The tables hold no clinical rows: labels stand in for gold, and rules on texts for predictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import agreement, dedup, joins, metrics, profile, resample
from curatrix.plans.registry import Tables, query

TOXIC = "scum|idiot|loser|trash|pathetic"
CATS = ("der", "les", "que", "the", "ing")


def _judged(t: Tables):
    docs = t.documents.select("doc_id", "lang", "n_chars", F.col("text").rlike(TOXIC).alias("p"))
    return t.labels.where(F.col("toxic").isNotNull()).select("doc_id", "quality", (F.col("toxic") == 1).alias("g")).join(docs, "doc_id")


_J = f"j AS (SELECT l.doc_id, lang, n_chars, quality, toxic = 1 AS g, regexp_matches(text, '{TOXIC}') AS p FROM labels l JOIN documents d USING (doc_id) WHERE toxic IS NOT NULL)"
_C = "count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE 1.0 * ({a}) / ({b}) END)"


_N, _SPEC = "(tp + fp + fn + tn)", _div("tn", "tn + fp")
_CH = _div("1.0 * (tp + fp) * (tp + fn) + 1.0 * (tn + fn) * (tn + fp)", f"1.0 * {_N} * {_N}")
_RATES = ", ".join(
    f"round({v}, 6) AS {k}"
    for k, v in {
        "accuracy": _div("tp + tn", _N), "precision": _div("tp", "tp + fp"), "recall": _div("tp", "tp + fn"), "f1": _div("2 * tp", "2 * tp + fp + fn"), "fpr": _div("fp", "fp + tn"), "fnr": _div("fn", "fn + tp"), "npv": _div("tn", "tn + fn"),
        "balanced_accuracy": f"({_div('tp', 'tp + fn')} + {_SPEC}) / 2", "macro_f1": f"({_div('2 * tp', '2 * tp + fp + fn')} + {_div('2 * tn', '2 * tn + fp + fn')}) / 2",
        "mcc": _div("1.0 * tp * tn - 1.0 * fp * fn", "sqrt(1.0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"), "kappa": _div(f"{_div('tp + tn', _N)} - {_CH}", f"1 - {_CH}"),
    }.items()
)


@query(f"WITH {_J} SELECT {_C} FROM j")
def verdict_confusion(t):
    return metrics.confusion(_judged(t), F.col("g"), F.col("p"))


@query(f"WITH {_J}, c AS (SELECT {_C} FROM j) SELECT *, {_RATES} FROM c")
def verdict_rates(t):
    return metrics.rates(metrics.confusion(_judged(t), F.col("g"), F.col("p")))


@query(f"WITH {_J}, c AS (SELECT lang, {_C} FROM j GROUP BY lang) SELECT *, {_RATES} FROM c")
def verdict_rates_by_group(t):
    return metrics.rates(metrics.confusion(_judged(t), F.col("g"), F.col("p"), "lang"))


_FLAG = f"regexp_matches(text, '{TOXIC}')"


@query(f"""WITH m AS (SELECT {_FLAG} AS g, quality = 0 AS p FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS n, count(*) FILTER (WHERE p IS NULL) AS n_unparsed, round(avg((g = coalesce(p, false))::INT), 6) AS fail_open, round(avg((g = coalesce(p, true))::INT), 6) AS fail_closed,
round(avg((g = coalesce(p, NOT g))::INT), 6) AS always_wrong, round(avg((g = p)::INT), 6) AS abstain FROM m""")
def unparsed_policies(t):
    m = t.documents.select("doc_id", F.col("text").rlike(TOXIC).alias("g")).join(t.labels.select("doc_id", (F.col("quality") == 0).alias("p")), "doc_id", "left")
    return metrics.policies(m, F.col("g"), F.col("p"))


@query("""WITH x AS (SELECT n_chars AS s, sum(quality) AS pos, sum(1 - quality) AS neg FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY n_chars),
c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM x)
SELECT round(1 - sum(pos * (fp - neg / 2.0)) / (max(tp) * max(fp)), 6) AS auroc, round(sum(1.0 * pos * tp / (tp + fp)) / max(tp), 6) AS average_precision FROM c""")
def auroc_avg_precision(t):
    j = t.labels.where("quality is not null").select("doc_id", "quality").join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return metrics.ranking(j, F.col("quality"), F.col("n_chars"))


def _flags(t):
    gold = F.array(*(F.col("text").contains(f" {c} ") for c in CATS))
    predicted = F.array(*(F.col("text").contains(c) for c in CATS))
    return metrics.long_form(t.documents, "doc_id", CATS, gold, predicted)


_F = "f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, contains(text, ' {c} ') AS g, contains(text, '{c}') AS p FROM documents" for c in CATS) + ")"


@query(f"""WITH {_F}, r AS (SELECT doc_id, count(*) FILTER (WHERE g AND p) AS b, count(*) FILTER (WHERE g) AS ng, count(*) FILTER (WHERE p) AS np, count(*) AS k FROM f GROUP BY doc_id),
c AS (SELECT category, {_C} FROM f GROUP BY category)
SELECT round(avg((ng + np - b = b)::INT), 6) AS subset_accuracy, round(1.0 * sum(ng + np - 2 * b) / sum(k), 6) AS hamming_loss, round(avg(CASE WHEN ng + np = 0 THEN 1.0 ELSE 2.0 * b / (ng + np) END), 6) AS samples_f1,
round(avg(CASE WHEN ng + np - b = 0 THEN 1.0 ELSE 1.0 * b / (ng + np - b) END), 6) AS samples_jaccard, round(2.0 * sum(b) / (sum(ng) + sum(np)), 6) AS micro_f1,
(SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) FROM c WHERE tp + fn > 0) AS macro_f1 FROM r""")
def multilabel_metrics(t):
    return metrics.multilabel(_flags(t), "doc_id")


@query(f"WITH {_F}, c AS (SELECT category, {_C} FROM f GROUP BY category) SELECT *, {_RATES} FROM c")
def per_category_table(t):
    return metrics.rates(metrics.confusion(_flags(t), F.col("g"), F.col("p"), "category"))


@query(f"""WITH {_F} SELECT category, CAST(sum(g::INT) AS BIGINT) AS n_positive, count(*) AS n, round(1.0 * sum(g::INT) / count(*), 6) AS prevalence, sum(g::INT) < 10 AS is_low FROM f GROUP BY category""")
def label_prevalence(t):
    return _flags(t).groupBy("category").agg(F.count_if("g").alias("n_positive"), F.count(F.lit(1)).alias("n"), F.round(F.count_if("g") / F.count(F.lit(1)), 6).alias("prevalence"), (F.count_if("g") < 10).alias("is_low"))


@query(f"""WITH {_J}, s AS (SELECT *, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS stratum FROM j)
SELECT stratum, count(*) AS n, round(avg((g = p)::INT), 6) AS accuracy, round(avg(p::INT), 6) AS flag_rate, round(avg(g::INT), 6) AS unsafe_rate FROM s GROUP BY stratum""")
def stratum_rates(t):
    from curatrix.functions.text import band

    j = _judged(t).withColumn("stratum", band(F.col("n_chars"), ((500, "short"), (2000, "medium")), "long"))
    return j.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c.cast("double")), 6).alias(k) for k, c in (("accuracy", F.col("g") == F.col("p")), ("flag_rate", F.col("p")), ("unsafe_rate", F.col("g")))))


@query(f"""WITH {_J}, c AS (SELECT {_C} FROM j), r AS (SELECT {_RATES} FROM c), g AS (SELECT 'G1 recall' AS gate, recall AS value, 0.97 AS bound, recall >= 0.97 AS passed FROM r UNION ALL SELECT 'G2 fpr', fpr, 0.2, fpr <= 0.2 FROM r UNION ALL SELECT 'G3 macro_f1', macro_f1, 0.68, macro_f1 >= 0.68 FROM r)
SELECT gate, CAST(value AS DOUBLE) AS value, CAST(bound AS DOUBLE) AS bound, passed FROM g""")
def metric_gates(t):
    r = metrics.rates(metrics.confusion(_judged(t), F.col("g"), F.col("p")))
    gates = (("G1 recall", "recall", 0.97, True), ("G2 fpr", "fpr", 0.2, False), ("G3 macro_f1", "macro_f1", 0.68, True))
    return r.select(F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(b).alias("bound"), (F.col(c) >= b if up else F.col(c) <= b).alias("passed")) for n, c, b, up in gates))).alias("x")).select("x.*")


def _votes(t):
    """Five raters of each labelled document: the gold label, flipped by a hash for one vote in eight; some missing."""
    h = lambda s: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(s), F.col("doc_id").cast("string"), F.col("rater").cast("string"))), 1, 4), 16, 10).cast("int")
    v = t.labels.select("doc_id", "quality", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rater"))
    return v.select("doc_id", "quality", "rater", F.when(h("miss") % 10 == 0, None).otherwise(F.when(h("flip") % 8 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).alias("vote"))


_H = "CAST('0x' || substr(md5('{s}:' || doc_id || ':' || rater), 1, 4) AS INT)"
_V = f"v AS (SELECT doc_id, quality, rater, CASE WHEN {_H.format(s='miss')} % 10 = 0 THEN NULL WHEN {_H.format(s='flip')} % 8 = 0 THEN 1 - quality ELSE quality END AS vote FROM labels, (SELECT unnest(range(1, 6)) AS rater))"


@query(f"""WITH {_V}, c AS (SELECT doc_id, vote, count(*) AS n FROM v WHERE vote IS NOT NULL GROUP BY ALL), f AS (SELECT doc_id, sum(n * n) AS sq FROM c GROUP BY doc_id HAVING sum(n) = 5),
s AS (SELECT vote, sum(n) AS n FROM c WHERE doc_id IN (SELECT doc_id FROM f) GROUP BY vote), e AS (SELECT 1.0 * sum(n * n) / (sum(n) * sum(n)) AS pe FROM s)
SELECT count(*) AS items, round((avg((sq - 5) / 20.0) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM f, e""")
def fleiss_kappa(t):
    return agreement.fleiss_kappa(_votes(t), "doc_id", "vote", 5)


@query(f"""WITH {_V}, c AS (SELECT doc_id, vote, count(*) AS n FROM v WHERE vote IS NOT NULL GROUP BY ALL), m AS (SELECT doc_id, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY doc_id HAVING sum(n) > 1),
s AS (SELECT vote, sum(n) AS n FROM c WHERE doc_id IN (SELECT doc_id FROM m) GROUP BY vote)
SELECT CAST(sum(m) AS BIGINT) AS votes, round(1 - sum((m * m - sq) / (m - 1.0)) * (sum(m) - 1) / (SELECT sum(n) * sum(n) - sum(n * n) FROM s), 6) AS alpha FROM m""")
def krippendorff_alpha(t):
    return agreement.krippendorff_alpha(_votes(t), "doc_id", "vote")


@query(f"""WITH {_V}, p AS (SELECT a.vote AS a, b.vote AS b FROM v a JOIN v b USING (doc_id) WHERE a.rater = 1 AND b.rater = 2 AND a.vote IS NOT NULL AND b.vote IS NOT NULL),
x AS (SELECT avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe, count(*) AS n FROM p) SELECT n, round((po - pe) / (1 - pe), 6) AS kappa FROM x""")
def cohen_kappa(t):
    v = _votes(t)
    both = v.groupBy("doc_id").agg(F.max(F.when(F.col("rater") == 1, F.col("vote"))).alias("a"), F.max(F.when(F.col("rater") == 2, F.col("vote"))).alias("b"))
    return agreement.cohen_kappa(both, "a", "b")


@query(f"""WITH {_V}, m AS (SELECT doc_id, any_value(quality) AS quality, sum(vote) * 2 > count(vote) AS majority FROM v GROUP BY doc_id)
SELECT quality, majority, count(*) AS n FROM m GROUP BY ALL""")
def majority_vs_gold(t):
    m = _votes(t).groupBy("doc_id").agg(F.any_value("quality").alias("quality"), (F.sum("vote") * 2 > F.count("vote")).alias("majority"))
    return m.groupBy("quality", "majority").agg(F.count(F.lit(1)).alias("n"))


def _indexed(t):
    return joins.positions(t.labels.select("doc_id", F.col("quality").cast("double").alias("x"), F.col("toxic").cast("double").alias("y")), "doc_id", 8, "i").drop("doc_id")


_B = "n AS (SELECT count(*) AS n FROM labels), r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, quality AS x, toxic AS y FROM labels), d AS (SELECT b, CAST('0x' || substr(md5('{s}:' || b || ':' || k), 1, 8) AS BIGINT) % n AS i FROM n, (SELECT unnest(range(0, {b})) AS b), unnest(range(0, n)) AS u(k))"


def _ci(b: int) -> str:
    return f"WITH {_B.format(s='ci', b=b)}, m AS (SELECT b, avg(x) AS m FROM d JOIN r USING (i) GROUP BY b) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS resamples FROM m"


def _pair(b: int) -> str:
    return f"WITH {_B.format(s='pair', b=b)}, m AS (SELECT b, avg(x - y) AS m FROM d JOIN r USING (i) GROUP BY b) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m > 0)::INT), 6) AS p_positive FROM m"


@query(_ci(100))
def bootstrap_ci(t):
    return resample.mean_ci(_indexed(t), t.labels.count(), "x", 100, "ci")


@query(_ci(1000))
def bootstrap_ci_1000(t):
    """With the reference's number of resamples for metrics."""
    return resample.mean_ci(_indexed(t), t.labels.count(), "x", 1000, "ci")


@query(_pair(100))
def paired_bootstrap(t):
    return resample.paired_delta(_indexed(t), t.labels.count(), "x", "y", 100, "pair")


@query(_pair(2000))
def paired_bootstrap_2000(t):
    """With the reference's number of resamples for paired differences."""
    return resample.paired_delta(_indexed(t), t.labels.count(), "x", "y", 2000, "pair")


@query(f"WITH {_J} SELECT count(*) FILTER (WHERE g = p AND g <> (quality = 0)) AS only_a, count(*) FILTER (WHERE g <> p AND g = (quality = 0)) AS only_b, count(*) FILTER (WHERE g = p AND g = (quality = 0)) AS both, count(*) FILTER (WHERE g <> p AND g <> (quality = 0)) AS neither FROM j")
def flip_counts(t):
    a, b = F.col("g") == F.col("p"), F.col("g") == (F.col("quality") == 0)
    return _judged(t).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"))


@query(f"""WITH {_J} SELECT CASE WHEN quality IS NULL THEN 'incomparable' WHEN p = (quality = 0) THEN 'agree' WHEN p THEN 'only_rule' ELSE 'only_label' END AS bucket, count(*) AS n FROM j GROUP BY 1""")
def agreement_buckets(t):
    bad = F.col("quality") == 0
    return _judged(t).groupBy(F.when(bad.isNull(), "incomparable").when(F.col("p") == bad, "agree").when(F.col("p"), "only_rule").otherwise("only_label").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows, 0 AS n_lost, 0 AS n_added FROM orders")
def partition_check(t):
    o = t.orders
    parts = [o.where(F.pmod("o_orderkey", F.lit(3)) == k) for k in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    lost, added = o.exceptAll(whole).agg(F.count(F.lit(1)).cast("int").alias("n_lost")), whole.exceptAll(o).agg(F.count(F.lit(1)).cast("int").alias("n_added"))
    return o.agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(lost)).join(F.broadcast(added))


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS stored FROM orders GROUP BY 1), r AS (SELECT o_custkey, sum(round(o_totalprice)) AS again FROM orders GROUP BY 1)
SELECT abs(stored - again) > 1 AS mismatch, count(*) AS n, round(max(abs(stored - again)), 2) AS worst FROM s JOIN r USING (o_custkey) GROUP BY 1""")
def audit_diff(t):
    """Prices have two digits, so many differences are 1 exactly: which side their float sums fall on depends on the order."""
    sums = {"stored": F.sum("o_totalprice"), "again": F.sum(F.round("o_totalprice"))}
    g = joins.in_order(t.orders.where("o_custkey is not null"), ["o_custkey"], ["o_orderkey", "o_totalprice"], sums).withColumn("d", F.abs(F.col("stored") - F.col("again")))
    return g.groupBy((F.col("d") > 1).alias("mismatch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("d"), 2).alias("worst"))


@query("""WITH h AS (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS home FROM orders GROUP BY 1) SELECT o_orderpriority = home AS kept, count(*) AS n FROM orders JOIN h USING (o_custkey) GROUP BY 1""")
def keep_mask(t):
    home = t.orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("home"))
    return t.orders.join(home, "o_custkey").groupBy((F.col("o_orderpriority") == F.col("home")).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY ALL) SELECT *, v = max(v) OVER (PARTITION BY c_mktsegment) AS is_best FROM g""")
def best_value_mask(t):
    from pyspark.sql.window import Window

    g = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("v"))
    return g.withColumn("is_best", F.col("v") == F.max("v").over(Window.partitionBy("c_mktsegment")))


@query("""WITH m AS (SELECT c_nationkey AS step, round(avg(c_acctbal), 4) AS f1, round(avg((c_acctbal > 0)::INT), 6) AS recall FROM customer GROUP BY 1), ok AS (SELECT * FROM m WHERE recall >= 0.9), p AS (SELECT * FROM ok UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM ok))
SELECT step, f1, recall FROM p ORDER BY f1 DESC, step LIMIT 1""")
def constrained_argmax(t):
    m = t.customer.groupBy(F.col("c_nationkey").alias("step")).agg(F.round(F.avg("c_acctbal"), 4).alias("f1"), F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 6).alias("recall"))
    # Those over the floor first; where there are none, the best of all.
    return m.orderBy((F.col("recall") >= 0.9).desc(), F.desc("f1"), "step").limit(1)


@query("""SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_reward, round(var_pop(value), 4) AS variance, round(max(value) - min(value), 6) AS gap,
CASE WHEN count(*) < 3 THEN 'few' WHEN max(value) - min(value) < 1e-6 THEN 'unanimous' WHEN avg(value) < 20 THEN 'hard' WHEN var_pop(value) > 500 THEN 'unstable' ELSE 'easy' END AS reason FROM events GROUP BY user_id""")
def hard_example_mining(t):
    v, n = F.col("value"), F.count(F.lit(1))
    gap = F.max(v) - F.min(v)
    reason = F.when(n < 3, "few").when(gap < 1e-6, "unanimous").when(F.avg(v) < 20, "hard").when(F.var_pop(v) > 500, "unstable").otherwise("easy")
    return t.events.groupBy("user_id").agg(n.alias("n"), F.round(F.avg(v), 6).alias("mean_reward"), F.round(F.var_pop(v), 4).alias("variance"), F.round(gap, 6).alias("gap"), reason.alias("reason"))


@query(f"""WITH b AS (SELECT DISTINCT doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)), f AS (SELECT md5(text) AS k, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1),
j AS (SELECT d.lang, toxic = 1 AS g, {_FLAG} AS p FROM documents d JOIN labels USING (doc_id) JOIN f USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM b)), c AS (SELECT lang, {_C} FROM j GROUP BY lang) SELECT *, {_RATES} FROM c""")
def leakage_screened_report(t):
    docs = t.documents.where("text is not null")
    first = docs.groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    leaked = dedup.contained(docs, "doc_id", "text", t.benchmark, "item_id", "text").select("doc_id").distinct()
    judged = docs.select("doc_id", "lang", F.col("text").rlike(TOXIC).alias("p")).join(t.labels.select("doc_id", (F.col("toxic") == 1).alias("g")), "doc_id")
    kept = judged.join(first, "doc_id", "left_semi").join(leaked, "doc_id", "left_anti")
    return metrics.rates(metrics.confusion(kept, F.col("g"), F.col("p"), "lang"))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT a, sum(n) AS r FROM c GROUP BY a), k AS (SELECT b, sum(n) AS k FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c)
SELECT round(sum(pow(coalesce(n, 0) - 1.0 * r * k / t, 2) / (1.0 * r * k / t)), 4) AS chi_square, (count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS dof FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b""")
def chi_square_independence(t):
    return profile.chi_square(t.orders, "o_orderstatus", "o_orderpriority")
