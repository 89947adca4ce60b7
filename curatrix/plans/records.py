"""Draws, records, rewards and mined groups: on the driver's tables where they have such rows, else on golden cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import semi, text
from curatrix.operators import draws, training
from curatrix.plans.golden import NAMES, golden, told
from curatrix.plans.registry import add, query

_LOT = "md5('{s}:' || {k})"


@query(f"""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY -value, {_LOT.format(s='best', k='event_id')}, event_id) AS turn, max(value) OVER (PARTITION BY user_id) AS b FROM events) SELECT user_id, event_id, turn::INT AS turn FROM r ORDER BY turn, b DESC, user_id LIMIT 60""")
def best_first_round_robin(t):
    return draws.best_first_rounds(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", -F.col("value"), 60, "best")


@query(f"""WITH p AS (SELECT o_orderkey, o_orderpriority, o_custkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY {_LOT.format(s='lim', k='o_orderkey')}, o_orderkey) AS p FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p, {_LOT.format(s='lim', k='o_orderkey')}, o_orderkey) AS b FROM p WHERE p <= 2) SELECT o_orderkey, o_orderpriority, o_custkey FROM b WHERE b <= 50""")
def limited_by_profile(t):
    return draws.limited(t.orders.select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderpriority", "o_custkey", "o_orderkey", 2, 50, "lim")


@query(f"""WITH m AS (SELECT doc_id, lang, source, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT lang, quality, count(*) AS n FROM m GROUP BY ALL), x AS (SELECT *, round(n * 60 / (sum(n) OVER ()), 9) AS x FROM c),
q AS (SELECT lang, quality, least(n, floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang, quality) <= 60 - sum(floor(x)) OVER () THEN 1 ELSE 0 END) AS q FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, quality, source ORDER BY {_LOT.format(s='strat', k='doc_id')}, doc_id) AS k FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY k, source) AS o FROM k)
SELECT doc_id, o.lang, o.quality, source FROM o JOIN q USING (lang, quality) WHERE o <= q""")
def stratified_draw(t):
    m = t.documents.select("doc_id", "lang", "source").join(t.labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    return draws.stratified(m, ["lang", "quality"], "source", "doc_id", 60, "strat").select("doc_id", "lang", "quality", "source")


_FLAG = {"der": "contains(text, ' der ')", "les": "contains(text, ' les ')"}


@query("WITH f AS (SELECT doc_id, " + ", ".join(f"{c} AS f_{k}, row_number() OVER (PARTITION BY {c} ORDER BY {_LOT.format(s='floor', k='doc_id')}, doc_id) AS r_{k}" for k, c in _FLAG.items()) + " FROM documents), g AS (SELECT doc_id, " + " OR ".join(f"coalesce(f_{k} AND r_{k} <= 15, false)" for k in _FLAG) + f" AS forced FROM f) SELECT doc_id, forced FROM g ORDER BY forced DESC, {_LOT.format(s='floor', k='doc_id')}, doc_id LIMIT 80")
def floored_draw(t):
    return draws.floored(t.documents.select("doc_id", "text"), "doc_id", {k: F.col("text").contains(f" {k} ") for k in _FLAG}, 15, 80, "floor").select("doc_id", "forced")


@query(f"SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {_LOT.format(s='cal', k='doc_id')}, doc_id) <= 2 THEN 'calibration' ELSE 'main' END AS block FROM documents")
def calibration_blocks(t):
    return draws.blocks(t.documents.select("doc_id", "source"), "source", "doc_id", 2, "cal")


@query(f"""WITH p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem WHERE l_partkey <> l_suppkey), e AS (SELECT lo AS x FROM p UNION ALL SELECT hi FROM p), c AS (SELECT x FROM e GROUP BY 1 HAVING count(*) >= 5),
f AS (SELECT x, row_number() OVER (ORDER BY {_LOT.format(s='neg', k='x')}, x) AS i FROM c), w AS (SELECT least(a.x, b.x) AS lo, greatest(a.x, b.x) AS hi, a.i AS i, b.i AS j FROM f a JOIN f b ON a.i < b.i WHERE b.i <= 400)
SELECT lo, hi FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.lo = w.lo AND p.hi = w.hi) ORDER BY j, i LIMIT 40""")
def negative_pairs(t):
    return draws.unknown_pairs(t.lineitem, "l_partkey", "l_suppkey", 5, 40, "neg")


@query(f"""WITH k AS (SELECT user_id, avg(value) AS m, var_pop(value) AS v, min(value) < 5 AS safe FROM events GROUP BY 1), kept AS (SELECT * FROM k WHERE m < 50), n AS (SELECT ceil((0.9 * count(*) - count(*) FILTER (WHERE safe)) / (1 - 0.9)) AS need FROM kept),
o AS (SELECT *, row_number() OVER (ORDER BY round(v, 6) DESC, {_LOT.format(s='top', k='user_id')}, user_id) AS o FROM k WHERE safe AND user_id NOT IN (SELECT user_id FROM kept)) SELECT user_id, safe, false AS added FROM kept UNION ALL SELECT user_id, safe, true FROM o, n WHERE o <= need""")
def safe_top_up(t):
    k = t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.round(F.var_pop("value"), 6).alias("v"), (F.min("value") < 5).alias("safe"))
    return draws.topped_up(k.where("m < 50"), k, "user_id", "safe", 0.9, "v", "top").select("user_id", "safe", "added")


_LISTS = {"train": ("small", "red"), "test": ("ring", "bolt")}


@query("WITH h AS (SELECT p_partkey, (contains(p_name, 'small') OR contains(p_name, 'red')) AS a, (contains(p_name, 'ring') OR contains(p_name, 'bolt')) AS b FROM part) SELECT CASE WHEN a THEN 'train' WHEN b THEN 'test' ELSE 'validation' END AS part, a::INT + b::INT AS n_lists, count(*) AS n FROM h GROUP BY ALL")
def first_list_split(t):
    """The old split, which puts rows that name drugs of two lists into the first: their number shows how much it leaks."""
    return t.part.select(draws.first_list(F.col("p_name"), _LISTS, "validation").alias("s")).groupBy("s.part", "s.n_lists").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = "CASE WHEN CAST('0x' || substr(md5('split:' || source), 1, 8) AS BIGINT) % 100 < 75 THEN 'train' WHEN CAST('0x' || substr(md5('split:' || source), 1, 8) AS BIGINT) % 100 < 85 THEN 'validation' ELSE 'test' END"


@query(f"WITH s AS (SELECT doc_id, {_SPLIT} AS part, n_chars < 100 AS short FROM documents) SELECT part, count(*) AS n FROM s WHERE part = 'test' OR NOT short GROUP BY 1")
def filtered_after_split(t):
    """A filter for training and validation only: the test part stays as it was split."""
    from curatrix.operators.sample import split

    return t.documents.withColumn("part", split("source", "split")).where("part = 'test' or n_chars >= 100").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_number() OVER (PARTITION BY lang ORDER BY {_LOT.format(s='key', k='doc_id')}, doc_id)::INT AS row, lang, doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)")
def annotation_key(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return training.answer_key(d, "lang", "doc_id", ["quality", "toxic"], "key")


@query("""SELECT c_custkey, 'Judge: {"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS prompt FROM customer""")
def blind_prompts(t):
    return training.prompt(t.customer, "c_custkey", ["c_name", "c_acctbal", "c_nationkey"], "Judge: %s")


_COND = {"full": ("Profile", "Order", "Scenario"), "no profile": ("Order", "Scenario"), "profile only": ("Profile",), "scenario only": ("Scenario",)}
_BLOCK = {"Profile": "c_mktsegment", "Order": "CAST(c_nationkey AS VARCHAR)", "Scenario": "c_name"}


@query(" UNION ALL ".join(f"SELECT c_custkey, '{c}' AS condition, " + " || chr(10) || chr(10) || ".join(f"'{b}:' || chr(10) || {_BLOCK[b]}" for b in shown) + " AS message FROM customer" for c, shown in _COND.items()))
def withheld_blocks(t):
    return training.withheld(t.customer, "c_custkey", {"Profile": F.col("c_mktsegment"), "Order": F.col("c_nationkey").cast("string"), "Scenario": F.col("c_name")}, _COND)


@query("""WITH r AS (SELECT user_id AS part, o AS source, n, c, roles FROM (SELECT user_id % 3 AS user_id, event_id // 3 AS o, count(*) AS n, count(*) FILTER (WHERE value > 50) AS c, count(DISTINCT value > 50) AS roles FROM events GROUP BY ALL)) SELECT part, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(c) AS BIGINT) AS n_twins, count(*) FILTER (WHERE roles = 2) AS n_pairs, 2 * count(*) FILTER (WHERE roles = 2) AS n_mirrored FROM r GROUP BY part""")
def twin_summary(t):
    e = t.events.select((F.col("user_id") % 3).alias("part"), F.floor(F.col("event_id") / 3).alias("source"), F.when(F.col("value") > 50, "counterfactual").otherwise("original").alias("role"))
    return training.twin_summary(e, "part", "source", "role")


@query("""WITH e AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'flip' ELSE 'same' END AS kind, length(props) AS tokens, event_id FROM events WHERE value > 40), b AS (SELECT user_id, arg_min(event_id, struct_pack(t := tokens, e := event_id)) FILTER (WHERE kind = 'flip') AS chosen, arg_min(event_id, struct_pack(t := tokens, e := event_id)) FILTER (WHERE kind = 'same') AS s FROM e GROUP BY 1) SELECT user_id, chosen, coalesce(s, -1) AS rejected FROM b WHERE chosen IS NOT NULL""")
def forced_flip_pairs(t):
    e = t.events.select("user_id", F.when(F.col("event_type").isin("view", "click"), "flip").otherwise("same").alias("kind"), F.length("props").alias("tokens"), "event_id", "value")
    return training.forced_pairs(e, ["user_id"], "kind", "tokens", "event_id", F.col("value") > 40, F.lit(-1).cast("long"))


@query("""WITH s AS (SELECT user_id % 50 AS g, event_id, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE value END AS r, user_id % 4 = 0 OR value < 3 AS wrong FROM events), m AS (SELECT g, bool_and(wrong) AS w, max(r) - min(r) AS d, arg_min(event_id, struct_pack(r := r, e := event_id)) AS o FROM s GROUP BY 1) SELECT event_id, w AND d < 1e-6 AND event_id = o AS replaced FROM s JOIN m USING (g)""")
def reference_for_unanimous(t):
    s = t.events.select((F.col("user_id") % 50).alias("g"), "event_id", F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(F.col("value")).alias("r"), ((F.col("user_id") % 4 == 0) | (F.col("value") < 3)).alias("wrong"))
    return training.with_reference(s, "g", "event_id", "r", F.col("wrong")).select("event_id", "replaced")


# Sets as bits: said and gold of every event, made of its numbers.
_BITS = "s AS (SELECT user_id, event_id % 8 AS s, user_id % 8 AS g, value FROM events), b AS (SELECT *, bit_count((s & g)::BIGINT) AS n, bit_count(s::BIGINT) AS ns, bit_count(g::BIGINT) AS ng, CASE WHEN value > 90 THEN s <> 0 ELSE s = 0 END AS safe FROM s)"
_F1 = "(CASE WHEN ns + ng = 0 THEN 1.0 ELSE 2.0 * n / (ns + ng) END)"
_REWARD = f"CASE WHEN value < 5 THEN -1.0 ELSE round((CASE WHEN safe = (g = 0) THEN 0.5 ELSE 0.0 END) + (CASE WHEN safe = (g = 0) THEN 1.0 ELSE 0.25 END) * 1.5 * {_F1} + 0.2 - (CASE WHEN safe <> (s = 0) THEN 0.3 ELSE 0 END) - (CASE WHEN g <> 0 AND safe THEN 1.0 ELSE 0 END) - 0.3 * (ns - n), 9) END"


@query(f"""WITH {_BITS}, r AS (SELECT user_id, {_REWARD} AS r FROM b) SELECT user_id, count(*) AS n, round(avg(r), 6) AS mean, round(var_pop(r), 6) AS variance, round(max(r) - min(r), 6) AS gap,
CASE WHEN count(*) < 2 OR max(r) - min(r) < 1e-6 THEN NULL WHEN avg(r) < 0.5 THEN 'hard' WHEN var_pop(r) > 0.6 THEN 'unstable' END AS reason FROM r GROUP BY user_id""")
def reward_mining(t):
    """Rewards of every sample, and the scenarios whose samples are hard or unstable."""
    some = lambda c: F.filter(F.transform(F.array(*map(F.lit, NAMES)), lambda n, i: F.when(F.shiftright(c, 2).isNull(), None).otherwise(F.when(F.pmod(F.floor(c / F.pow(F.lit(2), i)), F.lit(2)) == 1, n))), lambda x: x.isNotNull())
    s, g = F.col("event_id") % 8, F.col("user_id") % 8
    safe = F.when(F.col("value") > 90, s != 0).otherwise(s == 0)
    r = training.reward(F.col("value") >= 5, safe, g == 0, some(s), some(g), F.lit(None).cast("string"), F.lit(True), F.lit(100))
    return training.mined(t.events.select("user_id", "event_id", r["total"].alias("r")), "user_id", "event_id", "r", 0.5, 0.6)


_set = lambda c: F.array_remove(F.split(c, ";"), "")
golden("reward_terms", "parsed boolean, safe boolean, gold_safe boolean, said string, gold string, decisive string, complete boolean, chars long", "total double, bonus double, extra double, ceiling double", [
    (True, False, False, "Dosage Risk", "Dosage Risk", "Dosage Risk", True, 100, 3.0, 0.3, 0.0, 3.0), (True, False, False, "Dosage Risk;A", "Dosage Risk", "Dosage Risk", True, 100, 2.2, 0.3, -0.3, 3.0), (True, False, False, "Dosage Risk;A;B", "Dosage Risk", "Dosage Risk", True, 100, 1.9, 0.3, -0.6, 3.0),
    (True, True, False, "", "Dosage Risk", "Dosage Risk", True, 100, -0.675, 0.0, 0.0, 3.0), (True, True, True, "", "", None, True, 100, 2.2, 0.0, 0.0, 2.2), (False, None, True, "", "", None, False, 100, -1.0, 0.0, 0.0, 2.2),
    (True, False, False, "A", "A", "A", True, 9600, 2.65, 0.0, 0.0, 2.7), (True, True, True, "A", "", None, True, 100, 0.1, 0.0, -0.3, 2.2), (True, False, False, "A;B", "A;C", None, False, 100, 0.95, 0.0, -0.3, 2.2), (True, False, True, "A", "", None, True, 100, -0.1, 0.0, -0.3, 2.2),
], lambda p, s, g, a, b, d, c, n: [(r := training.reward(p, s, g, _set(a), _set(b), d, c, n, ("Dosage Risk",)))["total"], r["bonus"], r["extra"], training.ceiling(d, ("Dosage Risk",))])

_MAP = '{"Drug-Drug Interaction Risk": false, "Dosage Risk": %s, "Allergy Risk": false}'
golden("scenario_labels", "labels string, answer string", "safe boolean, gold string, decisive string, source string", [
    (_MAP % "true", None, False, "Dosage Risk", "Dosage Risk", "labels"), (None, 'x {"Dosage": "yes", "allergy risk": true}', False, "Dosage Risk;Allergy Risk", None, "answer"), (_MAP % "false", "{}", True, "", None, "labels"), ("broken", "none", None, None, None, "none"),
], lambda a, b: [(s := training.scenario(a, b, NAMES))["safe"], told(s["gold"]), s["decisive"], s["source"]])

_TEXT = '{\n  "reasoning": "why",\n  "risk_analysis": {\n    "Drug-Drug Interaction Risk": false,\n    "Dosage Risk": true,\n    "Allergy Risk": false\n  },\n  "is_safe": false\n}'
golden("answer_formats", "teacher string, student string", "answer string, guard string, back string", [
    (" why ", "other", _TEXT, "unsafe\nO2", _TEXT), ("", "why", _TEXT, "unsafe\nO2", _TEXT), (None, None, _TEXT.replace("why", ""), "unsafe\nO2", _TEXT.replace("why", "")),
], lambda a, b: [(made := training.answer(a, b, F.lit(False), F.array(F.lit(False), F.lit(True), F.lit(False)), NAMES)), (g := training.json_to_guard(F.get_json_object(made, "$.risk_analysis"), NAMES)), training.guard_to_json(g, NAMES, F.coalesce(F.nullif(F.trim(a), F.lit("")), F.trim(b), F.lit("")))])
golden("stored_context", "stored string, again string", "patient string, drug string", [('{"patient": "p", "order": "o", "x": 1}', "n", "p", "o"), ('{"patient": "p"}', "n", "p", "n"), ("bad", "n", None, "n")], lambda s, n: [F.element_at(m := training.kept_blocks(s, ("patient", "order"), {"order": n}), "patient"), F.element_at(m, "order")])
golden("staged_targets", "said string", "target string", [("Verdict: SAFE\nAudit:\nfine", "[AUDIT]\nfine\n\n[VERDICT]\nSAFE"), ("Audit:\nonly", None)], lambda c: [training.staged(c, {"audit": "AUDIT", "verdict": "VERDICT"}, ("AUDIT", "VERDICT"))])
golden("impersonal_messages", "said string", "plain string, impersonal boolean", [("Patient profile:\n- Age: 4\n- Sex: f\n\nScenario:\nIs 5 mg safe?", "Scenario:\nIs 5 mg safe?", True), ("Scenario:\nA 45-year-old woman", "Scenario:\nA 45-year-old woman", False)], lambda c: [(p := records_plain(c)), training.impersonal(p)])


def records_plain(c):
    from curatrix.operators.records import nonpersonal

    return nonpersonal(c)


_SAID = "The kidneys suffer.\n- Renal Risk: True. CKD\n- Liver Risk: True. none\n- Age Risk: FALSE. old"


def audit_line_pairs(t):
    rows = t.spark.createDataFrame([(1, _SAID, ["Renal Risk", "Age Risk"]), (2, "- Renal Risk: false", ["Renal Risk"]), (3, "no lines", [])], "id long, said string, gold array<string>")
    return training.audit_pairs(rows, "id", F.col("said"), F.col("gold"), ("Renal Risk", "Liver Risk", "Age Risk"), {"Renal Risk": ["kidney"], "Liver Risk": ["hepat"], "Age Risk": ["elderly"]})


add("audit_line_pairs", "SELECT CAST(id AS BIGINT) AS id, name, kind, chosen, rejected, tier FROM (VALUES (1, 'Renal Risk', 'same', 'True', 'False', NULL), (1, 'Liver Risk', 'flip', 'False', 'True', NULL), (1, 'Age Risk', 'flip', 'True', 'False', 'minor'), (2, 'Renal Risk', 'flip', 'True', 'False', 'sole')) v(id, name, kind, chosen, rejected, tier)", audit_line_pairs)
golden("map_lookups", "said string", "plain string, dashed string, labels string", [('{"a-b": "1"}', "1", "1", "1"), ('{"a–b": "2"}', None, "2", "2"), ("{'a-b': True}", "true", "true", "true")], lambda c: [F.element_at(m := semi.json_map(c), "a-b"), semi.lookup(m, "a-b"), text.norm(semi.lookup(m, "a-b"))])
