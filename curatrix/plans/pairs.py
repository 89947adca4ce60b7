"""Preference pairs, curation rounds, the split search and the text probe on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import pairs, sample, search, twins
from curatrix.plans.registry import query

_K = ("der", "les", "que", "the")
_HALF = "CAST('0x' || substr(md5('half:' || doc_id), 1, 8) AS BIGINT) % 2 = 0"
_F = "n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(_K)) + ") AS v(i, name)), f AS (SELECT doc_id, i, name, contains(coalesce(text, ''), ' ' || name || ' ') AS x, contains(coalesce(text, ''), name) AS near FROM documents, n)"


def _flags(t):
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.array(*(text.contains(f" {k} ") for k in _K)).alias("g"), F.array(*(text.contains(k) for k in _K)).alias("near"))


def _bits(c):
    return F.array_join(F.transform(c, lambda b: b.cast("int").cast("string")), "")


@query(
    f"WITH {_F}, h AS (SELECT *, md5(CASE WHEN x THEN 'neg-t:' ELSE 'neg-f:' END || doc_id || ':' || name) AS h FROM f), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY h, i) - 1 AS rn, count(*) OVER (PARTITION BY doc_id, x) AS c FROM h), "
    "q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, i) - 1 AS hn, count(*) OVER (PARTITION BY doc_id) AS hc FROM h WHERE NOT x AND near), "
    "e AS (SELECT doc_id, 'drop_true' AS neg_type, i AS off, -1 AS up FROM r WHERE x UNION ALL SELECT doc_id, 'add_false', -1, i FROM r WHERE NOT x AND rn < 2 UNION ALL SELECT doc_id, 'add_false_hard', -1, i FROM q WHERE hn < 2 "
    "UNION ALL SELECT a.doc_id, 'swap', a.i, b.i FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.x AND NOT b.x AND a.rn < 2 AND b.rn = a.rn % b.c UNION ALL SELECT a.doc_id, 'swap_hard', a.i, b.i FROM r a JOIN q b ON a.doc_id = b.doc_id AND a.x AND a.rn < 2 AND b.hn = a.rn % b.hc), "
    "o AS (SELECT e.doc_id, neg_type, off, up, string_agg(CASE WHEN i IN (off, up) THEN name END, '|' ORDER BY i) AS changed, sum(x::INT) AS n_true, string_agg(CASE WHEN i = off THEN '0' WHEN i = up THEN '1' ELSE x::INT::VARCHAR END, '' ORDER BY i) AS rejected FROM e JOIN f USING (doc_id) GROUP BY 1, 2, 3, 4) "
    "SELECT doc_id, neg_type, changed, n_true::BIGINT AS n_true, rejected, rejected NOT LIKE '%1%' AS rejected_safe FROM o"
)
def negative_kinds(t):
    got = pairs.negatives(_flags(t), "doc_id", "g", _K, ("drop_true", "add_false", "add_false_hard", "swap", "swap_hard"), "neg", 2, 2, "near")
    return got.withColumn("rejected", _bits(F.col("rejected")))


@query(
    "WITH d AS (SELECT source, arg_min(struct_pack(p := d.doc_id, a := md5(text)), d.doc_id) FILTER (WHERE quality = 0) AS o, arg_min(struct_pack(p := d.doc_id, a := md5(text)), d.doc_id) FILTER (WHERE quality = 1) AS c FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL GROUP BY 1) "
    "SELECT source, 'original' AS side, o.p AS prompt, o.a AS chosen, c.a AS rejected FROM d WHERE o IS NOT NULL AND c IS NOT NULL UNION ALL SELECT source, 'counterfactual', c.p, c.a, o.a FROM d WHERE o IS NOT NULL AND c IS NOT NULL"
)
def directed_pairs(t):
    d = t.documents.where("text is not null").join(t.labels, "doc_id").select("source", "doc_id", "quality", F.struct(F.col("doc_id").alias("prompt"), F.md5("text").alias("answer")).alias("s"))
    pick = lambda q: F.min_by(F.when(F.col("quality") == q, F.col("s")), F.when(F.col("quality") == q, F.col("doc_id")))
    both = d.groupBy("source").agg(pick(0).alias("o"), pick(1).alias("c")).where("o is not null and c is not null")
    return pairs.directed(both, "source", "o", "c")


@query(f"WITH {_F}, e AS (SELECT doc_id, string_agg(CASE WHEN near AND NOT x THEN 'FP:' || name END, ',' ORDER BY i) AS tags FROM f GROUP BY 1) SELECT tags, count(*) AS n, min(doc_id) AS first_id FROM e WHERE tags IS NOT NULL GROUP BY 1")
def onpolicy_errors(t):
    tags = _flags(t).select("doc_id", F.array_join(pairs.error_tags(F.col("near"), F.col("g"), _K), ",").alias("tags")).where("tags <> ''")
    return tags.groupBy("tags").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "WITH s AS (SELECT l_orderkey, l_returnflag = 'R' AS a, l_linestatus = 'O' AS b, l_quantity > 25 AS c, l_partkey AS t, l_linenumber AS ans FROM lineitem), w AS (SELECT *, (NOT a)::INT + b::INT + (NOT c)::INT AS w FROM s), "
    "p AS (SELECT l_orderkey, a, b, c, w, min(t) AS t, arg_min(ans, struct_pack(t := t, ans := ans)) AS rejected FROM w GROUP BY ALL), g AS (SELECT l_orderkey, arg_min(ans, struct_pack(t := t, ans := ans)) FILTER (WHERE w = 0) AS chosen FROM w GROUP BY 1), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w, t, rejected) AS rn FROM p WHERE w > 0) SELECT l_orderkey, rn::INT AS rn, w::BIGINT AS n_wrong, chosen, rejected, chosen IS NOT NULL AS own FROM r JOIN g USING (l_orderkey) WHERE rn <= 2"
)
def self_play_pairs(t):
    """Lines of an order stand in for sampled answers, their part keys for token counts."""
    flags = F.array(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 25)
    s = t.lineitem.select("l_orderkey", flags.alias("flags"), F.array(F.lit(True), F.lit(False), F.lit(True)).alias("gold"), "l_partkey", "l_linenumber")
    return pairs.self_play(s, "l_orderkey", "flags", "gold", "l_partkey", "l_linenumber", 2)


@query("WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS own FROM orders), n AS (SELECT floor(sum(own::INT) * 0.2 / (1 - 0.2) + 1e-9) AS room FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY md5('gold:' || o_orderkey), o_orderkey) AS rn FROM o) SELECT own, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r, n WHERE own OR rn <= room GROUP BY 1")
def gold_share_cap(t):
    own = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("own"))
    return pairs.gold_share(own, "own", "o_orderkey", 0.2, "gold").groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"WITH {_F}, d AS (SELECT doc_id, min(i) FILTER (WHERE x) AS d FROM f GROUP BY 1), m AS (SELECT doc_id, i, name AS missed FROM f JOIN d USING (doc_id) WHERE x AND i <> d) SELECT m.doc_id, m.missed, string_agg((f.x AND f.i <> m.i)::INT::VARCHAR, '' ORDER BY f.i) AS rejected FROM m JOIN f ON m.doc_id = f.doc_id GROUP BY 1, 2")
def partial_miss_pairs(t):
    """The first true label is decisive."""
    first = F.get(F.array(*map(F.lit, _K)), F.array_position("g", True).cast("int") - 1)
    got = pairs.partial_miss(_flags(t).withColumn("d", F.when(F.array_contains("g", True), first)), "doc_id", "g", "d", _K)
    return got.select("doc_id", "missed", _bits(F.col("rejected")).alias("rejected"))


@query(f"WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY md5('plan:' || doc_id), doc_id) AS rn FROM f) SELECT r.doc_id, r.name AS target, r.rn::INT AS rn, string_agg((CASE WHEN f.i = r.i THEN NOT f.x ELSE f.x END)::INT::VARCHAR, '' ORDER BY f.i) AS labels FROM r JOIN f ON r.doc_id = f.doc_id WHERE rn <= 25 GROUP BY 1, 2, 3")
def relabel_plan(t):
    got = pairs.relabel_plan(_flags(t), "doc_id", "g", _K, "flip1", 25, "plan")
    return got.withColumn("labels", _bits(F.col("labels")))


@query(
    f"WITH p AS (SELECT doc_id, lang, CASE WHEN {_HALF} THEN 'add' ELSE 'neutralize' END AS dir FROM documents WHERE lang IS NOT NULL), h AS (SELECT lang, dir, count(*) AS n FROM p JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL), "
    "l AS (SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), g AS (SELECT lang, dir, 30 + (dir = 'neutralize')::INT AS share FROM (SELECT DISTINCT lang FROM p), (VALUES ('neutralize'), ('add')) AS v(dir)), "
    "s AS (SELECT g.lang, g.dir, coalesce(room, 0) AS room, greatest(share - coalesce(h.n, 0), 0) AS short FROM g LEFT JOIN (SELECT lang, dir, count(*) AS room FROM l GROUP BY ALL) r ON g.lang = r.lang AND g.dir = r.dir LEFT JOIN h ON g.lang = h.lang AND g.dir = h.dir), "
    "w AS (SELECT lang, dir, CASE WHEN room > 0 THEN short + sum(CASE WHEN room = 0 THEN short ELSE 0 END) OVER (PARTITION BY lang) ELSE 0 END AS short FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY lang, dir ORDER BY md5('round:' || doc_id), doc_id) AS turn FROM l) SELECT doc_id, r.lang, r.dir, turn::INT AS turn FROM r JOIN w ON r.lang = w.lang AND r.dir = w.dir WHERE turn <= CASE WHEN short > 0 THEN floor(short * 1.3 + 1e-9) + 1 ELSE 0 END"
)
def curation_round(t):
    bit = F.conv(F.substring(sample.dice("doc_id", "half"), 1, 8), 16, 10).cast("long") % 2 == 0
    pool = t.documents.where("lang is not null").select("doc_id", "lang", F.when(bit, "add").otherwise("neutralize").alias("dir"))
    done = t.labels.where("toxic = 1").select("doc_id")
    have = pool.join(done, "doc_id").groupBy("lang", "dir").agg(F.count(F.lit(1)).alias("n"))
    return pairs.plan_round(pool, have, "lang", "dir", "doc_id", ("neutralize", "add"), 61, "round", done).select("doc_id", "lang", "dir", "turn")


@query("WITH u AS (SELECT doc_id, 'labelled' AS part, 0 AS o FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'long', 1 FROM documents WHERE n_chars > 1500), k AS (SELECT doc_id, arg_min(part, o) AS part FROM u GROUP BY 1) SELECT part, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM k WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def merged_sets(t):
    parts = [("labelled", t.labels.where("quality = 1").select("doc_id")), ("long", t.documents.where("n_chars > 1500").select("doc_id", "lang"))]
    got = pairs.merged(parts, "doc_id", t.labels.where("toxic = 1"))
    return got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


_MARKS = tuple(f"o_orderpriority = '{p}'" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM"))


def _customers(t):
    return search.groups(t.orders, "o_custkey", F.col("o_orderstatus") == "F", [F.expr(m) for m in _MARKS])


def _share_sql(restart: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('search:' || {restart} || ':' || {key}), 1, 8) AS BIGINT) / 4294967296.0"


_COST = " + ".join(
    f"3.0 * (part > 0 AND p{i} = 0)::INT + 0.5 * (part > 0 AND p{i} < 3)::INT + 8.0 * abs(p{i} / greatest(sum(p{i}) OVER w, 1) - n / sum(n) OVER w) / {3 * len(_MARKS)}" for i in range(len(_MARKS))
)


def _scores_sql(restarts: int) -> str:
    return (
        "WITH g AS (SELECT o_custkey AS k, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS u, " + ", ".join(f"sum(({m})::INT) AS p{i}" for i, m in enumerate(_MARKS)) + " FROM orders GROUP BY 1), "
        f"x AS (SELECT *, {_share_sql('r', 'k')} AS x FROM g, range(0, {restarts}) AS t(r)), h AS (SELECT r, CASE WHEN x < 0.75 THEN 0 WHEN x < 0.85 THEN 1 ELSE 2 END AS part, sum(n)::DOUBLE AS n, sum(u)::DOUBLE AS u, " + ", ".join(f"sum(p{i})::DOUBLE AS p{i}" for i in range(len(_MARKS))) + " FROM x GROUP BY ALL), "
        f"c AS (SELECT r, 100.0 * abs(n - (CASE part WHEN 0 THEN 0.75 WHEN 1 THEN 0.10 ELSE 0.15 END)::DOUBLE * sum(n) OVER w) / sum(n) OVER w + {_COST} + 2.0 * abs(u / greatest(n, 1) - sum(u) OVER w / sum(n) OVER w) AS x FROM h WINDOW w AS (PARTITION BY r)) SELECT r::INT AS restart, round(round(sum(x), 9) + 2e-10, 6) AS score FROM c GROUP BY 1"
    )


@query(_scores_sql(40))
def split_search_scores(t):
    """The objective of forty restarts; orders grouped by customer, so that no customer is in two parts."""
    return search.scores(_customers(t), "o_custkey", len(_MARKS), 40, "search").withColumn("score", F.round(F.col("score") + 2e-10, 6))


@query(_scores_sql(400))
def split_search_scores_400(t):
    """With the reference's number of restarts."""
    return search.scores(_customers(t), "o_custkey", len(_MARKS), 400, "search").withColumn("score", F.round(F.col("score") + 2e-10, 6))


def _split(t, restarts: int):
    stats = _customers(t)
    at = search.search(stats, "o_custkey", len(_MARKS), restarts)
    return stats.join(at, "o_custkey").groupBy("part").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), F.round(F.sum("unsafe") / F.sum("n"), 6).alias("unsafe_rate"))


@query()
def split_search(t):
    """Rows, verdict rate and labels of each part of the best split, after moves and swaps."""
    return _split(t, 100)


@query()
def split_search_400(t):
    """With the reference's number of restarts."""
    return _split(t, 400)


@query()
def tfidf_probe(t):
    """Held-out accuracy of a probe on document texts; every fourth document by crc32 is held out."""
    d = t.documents.join(t.labels.where("quality is not null"), "doc_id").withColumn("out", F.crc32(F.col("doc_id").cast("string")) % 4 == 0)
    got = search.probe(d.where("not out"), d.where("out"), "doc_id", "text", "quality")
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 6).alias("accuracy"))


_WORDS = {"de": ("der", "und"), "fr": ("les", "est"), "es": ("que", "los"), "en": ("the", "and")}
_HAS = lambda x: "CASE lang " + " ".join(f"WHEN '{k}' THEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in ws) for k, ws in _WORDS.items()) + " END"


@query(
    "WITH d AS (SELECT doc_id, lang, source, text FROM documents WHERE lang IN (" + ", ".join(f"'{k}'" for k in _WORDS) + ") AND NOT regexp_matches(coalesce(text, ''), '[\\[\\]()]')), "
    f"k AS (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[;,]'), lambda y: trim(y, ' ')), lambda x: x <> '' AND NOT ({_HAS('x')})), '; ') AS kept FROM d), "
    f"t AS (SELECT d.doc_id, lang, source, CASE WHEN {_HAS('text')} THEN coalesce(nullif(kept, ''), 'None') ELSE text END AS text FROM d LEFT JOIN k ON d.doc_id = k.doc_id) "
    "SELECT doc_id::VARCHAR AS doc_id, 'original' AS role, source, md5(text) AS digest FROM d UNION ALL SELECT doc_id || 'c', 'counterfactual', CASE WHEN lang = 'en' THEN 'neutral' ELSE source END, md5(text) FROM t"
)
def counterfactual_twins(t):
    """Languages stand in for risks, sentences for profile lists."""
    d = t.documents.where(F.col("lang").isin(*_WORDS) & ~F.coalesce("text", F.lit("")).rlike(r"[\[\]()]")).select("doc_id", "lang", "source", "text")
    made = twins.make(d, "doc_id", "lang", _WORDS, {"en": {"source": "neutral"}}, {"text": "None"})
    return twins.interleave(d, made, "doc_id", "lang").select("doc_id", F.col("Sample_Role").alias("role"), "source", F.md5("text").alias("digest"))
