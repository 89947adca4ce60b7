"""Curation queries: rules, profiles, duplicates, leakage, matching and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.operators import dedup, match, profile, rules
from curatrix.plans.registry import query

VOCAB = ("the", "der", "les", "una", "ring", "was", "and", "with")
_RULES = (("price_range", "error", "o_totalprice NOT BETWEEN 1000 AND 450000", "round(o_totalprice, 2)"), ("status", "error", "o_orderstatus NOT IN ('F', 'O')", "o_orderstatus"), ("vague_priority", "warning", "o_orderpriority LIKE '%NOT SPECIFIED%'", "o_orderpriority"), ("year", "warning", "year(o_orderdate) < 1996", "year(o_orderdate)"))
_ISSUES = " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS check_name, '{s}' AS severity, CAST({d} AS VARCHAR) AS detail FROM orders WHERE {c}" for n, s, c, d in _RULES)


def _issues(t):
    return rules.issues(t.orders, "o_orderkey", [rules.Rule(n, s, F.expr(c), F.expr(d)) for n, s, c, d in _RULES])


@query(_ISSUES)
def rule_issue_log(t):
    return _issues(t)


@query(f"WITH i AS ({_ISSUES}) SELECT check_name, count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning FROM i GROUP BY 1")
def rule_rollup(t):
    return rules.rollup(_issues(t))


@query("WITH p AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS n_missing, count(*) FILTER (WHERE n > 1 AND k IS NOT NULL) AS n_repeated, max(k) + 1 - count(k) AS n_absent FROM p")
def id_checks(t):
    return rules.id_issues(t.lineitem, "l_orderkey")


@query("WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), g AS (SELECT k, lead(k) OVER (ORDER BY k) AS nx FROM d) SELECT k + 1 AS gap_from, nx - 1 AS gap_to FROM g WHERE nx - k > 1 ORDER BY 1 LIMIT 10")
def id_gaps(t):
    return rules.gaps(t.lineitem, "l_orderkey", 10)


@query("SELECT l_returnflag, count(*) FILTER (WHERE abs(l_extendedprice * (1 - l_discount) / l_quantity - l_extendedprice / l_quantity) > 100) AS n_off, count(*) FILTER (WHERE l_tax > l_discount) AS n_tax, count(*) AS n FROM lineitem GROUP BY 1")
def consistency_check(t):
    off = F.abs(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity") - F.col("l_extendedprice") / F.col("l_quantity")) > 100
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(off).alias("n_off"), F.count_if(F.col("l_tax") > F.col("l_discount")).alias("n_tax"), F.count(F.lit(1)).alias("n"))


_COLS = ("c_name", "c_nationkey", "c_mktsegment")


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM customer" for c in _COLS) + ") SELECT column_name, count(*) AS n, count(*) - count(v) AS n_missing, count(DISTINCT v) AS n_distinct, round(1.0 * count(DISTINCT v) / greatest(count(v), 1), 6) AS distinct_ratio FROM l GROUP BY 1")
def column_profile(t):
    return profile.columns(t.customer, _COLS)


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, 1.0 * n / sum(n) OVER (PARTITION BY o_orderstatus) AS p FROM c) SELECT o_orderstatus, count(*) AS n_values, CASE WHEN count(*) > 1 THEN round(-sum(p * log2(p)) / log2(count(*)), 6) ELSE 0 END AS entropy FROM s GROUP BY 1")
def entropy_profile(t):
    return profile.entropy(t.orders, F.col("o_orderpriority"), "o_orderstatus")


@query("SELECT regexp_replace(regexp_replace(regexp_replace(url, '\\p{L}+', 'A', 'g'), '[0-9]+', '9', 'g'), '\\s+', ' ', 'g') AS signature, count(*) AS n, round(1.0 * count(*) / (SELECT count(*) FROM pages), 6) AS share FROM pages GROUP BY 1")
def format_patterns(t):
    return profile.patterns(t.pages, text.format_signature(F.col("url")))


@query("SELECT coalesce(o_orderstatus, 'ALL') AS o_orderstatus, count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(median(o_totalprice), 4) AS mid FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
def grouped_profile(t):
    p = F.col("o_totalprice")
    return t.orders.rollup("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(p), 2).alias("lo"), F.round(F.max(p), 2).alias("hi"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("sd"), F.round(F.median(p), 4).alias("mid")).withColumn("o_orderstatus", F.coalesce("o_orderstatus", F.lit("ALL")))


_STATUS = ("F", "O", "P")


@query("SELECT coalesce(o_orderpriority, 'TOTAL') AS o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s.lower()}" for s in _STATUS) + ", count(*) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def matrix_pivot_with_total(t):
    return profile.matrix(t.orders, "o_orderpriority", "o_orderstatus", _STATUS)


@query("SELECT coalesce(o_orderpriority, 'TOTAL') AS o_orderpriority, " + ", ".join(f"round(1.0 * count(*) FILTER (WHERE o_orderstatus = '{s}') / count(*), 6) AS {s.lower()}" for s in _STATUS) + " FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def fraction_matrix(t):
    m = profile.matrix(t.orders, "o_orderpriority", "o_orderstatus", _STATUS)
    return m.select("o_orderpriority", *(F.round(F.col(s.lower()) / F.col("total"), 6).alias(s.lower()) for s in _STATUS))


@query("WITH c AS (SELECT l_partkey, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, v) AS rn, sum(n) OVER (PARTITION BY l_partkey) AS t FROM c) SELECT l_partkey, v AS modal, round(1.0 * n / t, 6) AS share FROM r WHERE rn = 1")
def modal_value_with_fallback(t):
    return profile.modal(t.lineitem, "l_partkey", "l_returnflag", "l_returnflag")


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n FROM c ORDER BY n DESC, event_type LIMIT 3")
def value_counts_top(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("WITH s AS (SELECT unnest(range(0, 18)) AS k) SELECT k AS n_lines, count(o) AS n_orders FROM s LEFT JOIN (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1) ON n = k GROUP BY 1")
def histogram_zero_fill(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_orders"))
    return t.spark.range(18).select(F.col("id").alias("n_lines")).join(n, F.col("n_lines") == F.col("n"), "left").select("n_lines", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"))


@query("WITH k AS (SELECT md5(lower(trim(text))) AS group_key, doc_id FROM documents WHERE text IS NOT NULL) SELECT group_key, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t):
    return dedup.exact_groups(t.documents.where("text is not null"), "doc_id", F.lower(F.trim("text")))


@query("WITH a AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, (a.p_name = b.p_name)::INT + (a.p_brand = b.p_brand)::INT + (a.p_type = b.p_type)::INT + (a.p_size = b.p_size)::INT AS agree FROM a JOIN a b ON a.p_partkey < b.p_partkey WHERE (a.p_name = b.p_name)::INT + (a.p_brand = b.p_brand)::INT + (a.p_type = b.p_type)::INT + (a.p_size = b.p_size)::INT >= 3")
def column_agreement_pairs(t):
    return dedup.agreement_pairs(t.part, "p_partkey", ("p_name", "p_brand", "p_type", "p_size"), 3)


_TOKENS = "list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))"


@query(f"""WITH s AS (SELECT doc_id, lang, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), o AS (SELECT lang, t, min(doc_id) AS doc_id FROM s WHERE len(t) > 0 GROUP BY lang, t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM o a JOIN o b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= 0.92 * greatest(len(a.t), len(b.t)))
SELECT a, b, round(1.0 * i / (na + nb - i), 6) AS jaccard FROM p WHERE i >= 0.92 * (na + nb - i)""")
def near_duplicate_jaccard(t):
    links, member = dedup.near_pairs(t.documents.where("text is not null"), "doc_id", text.token_set(F.col("text")), 0.92, "lang")
    return dedup.named_links(links, member, "doc_id")


@query(f"""WITH s AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), o AS (SELECT t, min(doc_id) AS doc_id FROM s WHERE len(t) > 0 GROUP BY t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM o a JOIN o b ON a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= 0.92 * greatest(len(a.t), len(b.t)))
SELECT a, b, round(1.0 * i / (na + nb - i), 6) AS jaccard FROM p WHERE i >= 0.92 * (na + nb - i)""")
def near_duplicate_links(t):
    """near_duplicate_jaccard over all rows, whatever their language."""
    links, member = dedup.near_pairs(t.documents.where("text is not null"), "doc_id", text.token_set(F.col("text")), 0.92)
    return dedup.named_links(links, member, "doc_id")


@query(f"""WITH s AS (SELECT doc_id, text, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), k AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS text_head FROM s WHERE len(t) > 0),
o AS (SELECT t, min(doc_id) AS head, count(DISTINCT text) AS n_texts FROM k GROUP BY t),
p AS (SELECT a.head AS a, b.head AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM o a JOIN o b ON a.head < b.head AND least(len(a.t), len(b.t)) >= 0.92 * greatest(len(a.t), len(b.t))),
l AS (SELECT a, b FROM p WHERE i >= 0.92 * (na + nb - i)), e AS (SELECT h, count(*) AS n FROM (SELECT a AS h FROM l UNION ALL SELECT b FROM l) GROUP BY h)
SELECT doc_id, text_head, head, n_texts, coalesce(n, 0) AS n_links FROM k JOIN o USING (t) LEFT JOIN e ON h = head""")
def near_duplicate_members(t):
    """Each document's text, its token set and the links of that set in near_duplicate_links: with those, all pairs."""
    d = t.documents.where("text is not null").withColumn("text_key", F.xxhash64("text"))
    links, member = dedup.near_pairs(d, "doc_id", text.token_set(F.col("text")), 0.92, keep=("text_key",))
    return dedup.members(links, member, "doc_id", "text_key")


_SPLIT = "CASE WHEN CAST('0x' || substr(md5('split:' || doc_id), 1, 8) AS BIGINT) % 100 < 75 THEN 'train' WHEN CAST('0x' || substr(md5('split:' || doc_id), 1, 8) AS BIGINT) % 100 < 85 THEN 'validation' ELSE 'test' END"


@query(f"WITH s AS (SELECT md5(text) AS leak_key, {_SPLIT} AS part FROM documents WHERE text IS NOT NULL) SELECT leak_key, count(DISTINCT part) AS n_parts, count(*) AS n_rows FROM s GROUP BY 1 HAVING count(DISTINCT part) > 1")
def cross_split_leakage(t):
    from curatrix.operators.sample import split

    d = t.documents.where("text is not null").withColumn("part", split("doc_id", "split"))
    return dedup.shared_keys(d, "part", F.col("text"))


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def benchmark_contamination(t):
    return dedup.contained(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


_HIT = "regexp_matches(text, '(?i)(^|[^A-Za-z]){v}([^A-Za-z]|$)')"


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{v}' AS v FROM documents WHERE {_HIT.format(v=v)}" for i, v in enumerate(VOCAB)) + ") SELECT doc_id, string_agg(v, ',' ORDER BY o) AS hits FROM h GROUP BY 1")
def vocabulary_match_all(t):
    return t.documents.select("doc_id", F.array_join(match.all_hits(F.col("text"), VOCAB), ",").alias("hits")).where("hits <> ''")


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{v}' AS v, length(regexp_extract(text, '(?is)^(.*?)(?:^|[^A-Za-z]){v}(?:[^A-Za-z]|$)', 1)) AS place FROM documents WHERE {_HIT.format(v=v)}" for v in VOCAB) + ") SELECT doc_id, arg_min(v, struct_pack(a := place, b := v)) AS first_hit FROM h GROUP BY 1")
def earliest_match(t):
    return t.documents.select("doc_id", match.earliest(F.col("text"), VOCAB).alias("first_hit")).where("first_hit is not null")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{v}') THEN '{v}'" for v in sorted(VOCAB, key=lambda x: (-len(x), x))) + " END AS name FROM documents")
def longest_match(t):
    return t.documents.select("doc_id", match.longest(F.col("text"), VOCAB).alias("name"))


_RANK = "CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END"


@query(f"WITH e AS (SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, max({_RANK}) AS worst FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL), o AS (SELECT l_orderkey, worst FROM lineitem JOIN e ON lo = least(l_partkey, l_suppkey) AND hi = greatest(l_partkey, l_suppkey)) SELECT l_orderkey, max(worst) AS worst, count(*) AS n_pairs FROM o GROUP BY 1")
def severity_pair_lookup(t):
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    edges = match.worst_pair(t.lineitem, "l_partkey", "l_suppkey", rank)
    used = t.lineitem.select("l_orderkey", F.least("l_partkey", "l_suppkey").alias("lo"), F.greatest("l_partkey", "l_suppkey").alias("hi"))
    return used.join(edges, ["lo", "hi"]).groupBy("l_orderkey").agg(F.max("worst").alias("worst"), F.count(F.lit(1)).alias("n_pairs"))


@query("SELECT s_suppkey, c_custkey FROM supplier, customer WHERE abs(s_acctbal - c_acctbal) <= 0.5")
def tolerance_join(t):
    return match.tolerance(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 0.5).select("s_suppkey", "c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n, CASE WHEN count(o_orderkey) = 0 THEN 'no_order' WHEN max(o_totalprice) < 100000 THEN 'small' WHEN min(o_orderdate) > TIMESTAMP '1998-01-01' THEN 'late' ELSE 'kept' END AS drop_reason FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def drop_reasons(t):
    j = t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.count("o_orderkey")
    reason = F.when(n == 0, "no_order").when(F.max("o_totalprice") < 100000, "small").when(F.min("o_orderdate") > F.lit("1998-01-01").cast("timestamp"), "late").otherwise("kept")
    return j.groupBy("c_custkey").agg(n.alias("n"), reason.alias("drop_reason"))


@query("SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY ALL")
def anti_join_counts(t):
    c = t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    n = c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'only_customer' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only_supplier', count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer) UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def set_differences(t):
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return one("only_customer", c.subtract(s)).unionByName(one("only_supplier", s.subtract(c))).unionByName(one("both", c.intersect(s)))
