"""Sampling, caps, splits, preference pairs and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import sample
from curatrix.plans.registry import query
from curatrix.streaming import incremental


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('top:' || doc_id), doc_id) AS rn FROM documents) SELECT doc_id, lang, rn::INT AS rn FROM r WHERE rn <= 5")
def top_k_per_group(t):
    return sample.top_per_group(t.documents.select("doc_id", "lang"), "lang", "doc_id", 5, "top")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('spread:' || doc_id), doc_id) AS turn FROM documents) SELECT doc_id, source, turn::INT AS turn FROM r ORDER BY turn, source LIMIT 50")
def round_robin_spread(t):
    return sample.spread(t.documents.select("doc_id", "source"), "source", "doc_id", 50, "spread")


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT lang, n, n * 97.0 / sum(n) OVER () AS x FROM c), r AS (SELECT *, 97 - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS rn FROM e) SELECT lang, n, CAST(least(floor(x) + (rn <= rest)::INT, n) AS BIGINT) AS quota FROM r")
def quota_allocation(t):
    return sample.quotas(t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n", 97)


@query("WITH m AS (SELECT d.doc_id, lang, quality = 1 AS side FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL), n AS (SELECT lang, least(sum(side::INT), sum((NOT side)::INT), 20) AS n FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY lang, side ORDER BY md5('bal:' || doc_id), doc_id) AS rn FROM m) SELECT doc_id, r.lang, side FROM r JOIN n ON r.lang = n.lang WHERE rn <= n")
def balanced_take(t):
    m = t.documents.select("doc_id", "lang").join(t.labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    return sample.balanced(m, "lang", F.col("quality") == 1, "doc_id", 20, "bal").select("doc_id", "lang", "side")


@query("SELECT doc_id, k::INT AS copy, CASE WHEN k = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '_' || k END AS copy_id FROM labels, unnest(range(0, CASE WHEN quality = 0 THEN 3 ELSE 1 END)) AS u(k)")
def oversample_rare(t):
    return sample.oversample(t.labels, "doc_id", F.when(F.col("quality") == 0, 3).otherwise(1)).select("doc_id", "copy", "copy_id")


@query("WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('shift:' || c_custkey), c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT a.c_nationkey, a.c_custkey, b.c_custkey AS partner FROM r a JOIN r b ON a.c_nationkey = b.c_nationkey AND b.rn = a.rn % a.n + 1")
def derangement(t):
    return sample.derange(t.customer, "c_nationkey", "c_custkey", "shift")


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey, rn::INT AS rn FROM r WHERE (rn - 1) % 4 = 0 OR rn = n")
def every_kth_and_last(t):
    return sample.every_kth(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)


_SPLIT = "CASE WHEN CAST('0x' || substr(md5('split:' || source), 1, 8) AS BIGINT) % 100 < 75 THEN 'train' WHEN CAST('0x' || substr(md5('split:' || source), 1, 8) AS BIGINT) % 100 < 85 THEN 'validation' ELSE 'test' END"


@query(f"SELECT {_SPLIT} AS part, count(*) AS n, count(DISTINCT source) AS n_groups FROM documents GROUP BY 1")
def group_hash_split(t):
    return t.documents.groupBy(sample.split("source", "split").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_groups"))


@query()
def group_disjoint_split(t):
    """Components of customers and parts that share an order become atomic groups; groups go to one part each."""
    from curatrix.operators.split import disjoint

    edges = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).where("l_quantity >= 49 and l_linenumber = 1").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    return disjoint(edges, "split")


@query("WITH m AS (SELECT (o_custkey % 5) AS cell, o_orderstatus = 'F' AS side, o_orderkey FROM orders), n AS (SELECT cell, least(sum(side::INT), sum((NOT side)::INT)) AS n FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY cell, side ORDER BY md5('case:' || o_orderkey), o_orderkey) AS rn FROM m) SELECT r.cell, side, count(*) AS n, min(o_orderkey) AS first_key FROM r JOIN n ON r.cell = n.cell WHERE rn <= n.n GROUP BY ALL")
def case_control_match(t):
    m = t.orders.select((F.col("o_custkey") % 5).alias("cell"), "o_orderkey", "o_orderstatus")
    got = sample.balanced(m, "cell", F.col("o_orderstatus") == "F", "o_orderkey", 1 << 30, "case")
    return got.groupBy("cell", "side").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("WITH b AS (SELECT user_id, arg_max(event_id, struct_pack(v := value, i := -event_id)) AS chosen, arg_min(event_id, struct_pack(v := value, i := event_id)) AS rejected, max(value) - min(value) AS gap FROM events GROUP BY 1) SELECT user_id, chosen, rejected, round(gap, 4) AS gap FROM b WHERE gap >= 50")
def best_worst_pairs(t):
    best = F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("i")))
    worst = F.min_by("event_id", F.struct("value", "event_id"))
    return t.events.groupBy("user_id").agg(best.alias("chosen"), worst.alias("rejected"), F.round(F.max("value") - F.min("value"), 4).alias("gap")).where("gap >= 50")


_K = ("der", "les", "que", "the")


@query("WITH f AS (SELECT doc_id, [" + ", ".join(f"contains(text, ' {k} ')" for k in _K) + f"] AS g FROM documents), e AS (SELECT doc_id, g, unnest(range(1, {len(_K) + 1})) AS i FROM f) SELECT doc_id, (i - 1)::INT AS changed, CASE WHEN g[i] THEN 'drop_true' ELSE 'add_false' END AS neg_type, list_transform(g, lambda x, k: CASE WHEN k = i THEN NOT x ELSE x END)::VARCHAR AS rejected FROM e")
def negative_mutations(t):
    """Every label vector with one bit flipped: a row becomes as many rows as there are categories."""
    f = t.documents.select("doc_id", F.array(*(F.col("text").contains(f" {k} ") for k in _K)).alias("g"))
    flipped = lambda i: F.transform("g", lambda x, k: F.when(k == i, ~x).otherwise(x))
    kind = lambda i: F.when(F.get("g", i), "drop_true").otherwise("add_false")
    rows = f.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(_K) - 1)), lambda i: F.struct(i.alias("changed"), kind(i).alias("neg_type"), flipped(i).alias("r")))).alias("x"))
    return rows.select("doc_id", "x.changed", "x.neg_type", F.concat(F.lit("["), F.array_join(F.transform("x.r", lambda b: b.cast("string")), ", "), F.lit("]")).alias("rejected"))


@query("WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, value FROM r WHERE rn = 1")
def last_write_wins(t):
    return incremental.last_write(t.events, "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def resume_antijoin(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return incremental.pending(t.orders, done, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (event_id % 7)::INT AS shard, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def shard_modulo(t):
    return t.events.groupBy(F.pmod("event_id", F.lit(7)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT p.c_nationkey, 'p' || p.c_nationkey AS k, round(a - b, 4) AS delta FROM (SELECT c_nationkey, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS a, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS b FROM customer GROUP BY 1) p WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_condition_delta(t):
    seg = lambda s: F.avg(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal")))
    p = t.customer.groupBy("c_nationkey").agg(seg("BUILDING").alias("a"), seg("MACHINERY").alias("b")).where("a is not null and b is not null")
    return p.select("c_nationkey", F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("k"), F.round(F.col("a") - F.col("b"), 4).alias("delta"))


@query()
def greedy_tag_caps(t):
    """Keep a row while any of its tags is under its cap, then charge all; order by hash. Sequential by nature."""
    from curatrix.operators.split import greedy_caps

    tags = F.array_compact(F.array(*(F.when(F.col("text").contains(f" {k} "), F.lit(k)) for k in _K)))
    return greedy_caps(t.documents.select("doc_id", tags.alias("tags")), "doc_id", "tags", 40, "caps")
