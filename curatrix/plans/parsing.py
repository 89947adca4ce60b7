"""Parsing, cleaning, chat records and clinical text."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import clinical, semi, text
from curatrix.operators import records
from curatrix.plans.registry import query

NAMES = ("Drug-Drug Interaction Risk", "Dosage Risk", "Allergy Risk")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_map_sum(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at(semi.json_map(F.col("props")), "k").try_cast("long")).alias("total"))


@query("SELECT o_orderkey % 2 = 0 AS interaction, o_orderkey % 3 = 0 AS dosage, false AS allergy, 2 AS n_known, true AS ok, count(*) AS n FROM orders GROUP BY ALL")
def json_map_normalise(t):
    """Python-like label maps with other spellings: repaired, matched to the names, any true spelling wins."""
    bit = lambda n, yes, no: F.when(F.col("o_orderkey") % n == 0, yes).otherwise(no)
    raw = F.concat(F.lit("{'drug–drug interaction': "), bit(2, "True", "False"), F.lit(", 'Dosage Risk': '"), bit(3, "yes", "no"), F.lit("', 'other': True}"))
    c = semi.categories(semi.json_map(raw), NAMES)
    return t.orders.select(c.alias("c")).groupBy(F.get("c.flags", 0).alias("interaction"), F.get("c.flags", 1).alias("dosage"), F.get("c.flags", 2).alias("allergy"), F.col("c.n").alias("n_known"), F.col("c.ok").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 3 THEN NULL ELSE false END AS safe, count(*) AS n FROM orders GROUP BY 1")
def prose_verdict(t):
    said = F.element_at(F.array(F.lit("First unsafe, then SAFE."), F.lit("It is safe? No: unsafe"), F.lit("Verdict: not safe"), F.lit("no verdict")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.groupBy(semi.prose_verdict(said).alias("safe")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey % 3 = 0 AS safe, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Drug-Drug Interaction Risk,Allergy Risk' ELSE 'Dosage Risk' END AS names, count(*) AS n FROM orders GROUP BY ALL")
def guard_codes(t):
    said = F.element_at(F.array(F.lit("safe"), F.lit("unsafe\nO1,O3, O9\nO2"), F.lit("UNSAFE\nO2\nsafe")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    g = t.orders.select(semi.guard_codes(said, NAMES).alias("g"))
    return g.groupBy(F.col("g.safe").alias("safe"), F.array_join("g.names", ",").alias("names")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'json' AS source, false AS safe, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n FROM orders UNION ALL SELECT 'partial', false, count(*) FILTER (WHERE o_orderkey % 3 = 1) FROM orders UNION ALL SELECT 'prose', true, count(*) FILTER (WHERE o_orderkey % 3 = 2) FROM orders")
def completion_parser(t):
    said = F.element_at(F.array(F.lit('Sure: {"Is_Safe": false, "risk": {"Dosage Risk": true}} done'), F.lit('{"Is_Safe": false, "risk": {"Dosage Risk": true, "Aller'), F.lit("So the answer is SAFE")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    c = t.orders.select(semi.completion(said, NAMES).alias("c"))
    return c.groupBy("c.source", "c.safe").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY 1")
def chat_build(t):
    return records.chat(t.conversations, "conv_id", "turn", "role", "text")


@query("SELECT conv_id, arg_max(text, turn) AS gold FROM conversations WHERE role = 'assistant' GROUP BY 1")
def chat_gold(t):
    return t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("gold"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND turn = min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) THEN '[context]' || chr(10) || text ELSE text END AS text FROM conversations")
def context_inject(t):
    return records.inject(t.conversations, "conv_id", "turn", "role", "text", "[context]").select("conv_id", "turn", "text")


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b', '<IP>', 'g'), '\\b[0-9]{13,16}\\b', '<CARD>', 'g') AS text FROM documents")
def secret_scrub(t):
    clean, _ = text.rewrite(F.col("text"), ((r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "<IP>"), (r"\b[0-9]{13,16}\b", "<CARD>")))
    return t.documents.select("doc_id", clean.alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\b[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\b')) AS n_ip, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS n_mail FROM documents WHERE regexp_matches(text, '\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b|@')")
def leak_audit(t):
    ip, mail = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
    hit = t.documents.where(F.col("text").rlike(r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b|@"))
    return hit.select("doc_id", F.regexp_count("text", F.lit(ip)).cast("long").alias("n_ip"), F.regexp_count("text", F.lit(mail)).cast("long").alias("n_mail"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(s, '[#$%&*|]')), chr(10)) AS text FROM documents")
def line_drop(t):
    return t.documents.select("doc_id", F.array_join(F.filter(F.split("text", "\n"), lambda s: ~s.rlike(r"[#$%&*|]")), "\n").alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part")
def banding(t):
    return t.part.select("p_partkey", text.band(F.col("p_size"), ((10, "small"), (30, "medium")), "large").alias("band"))


@query("SELECT p_partkey, p_size * 0.001 AS mg, 24.0 / (p_size % 12 + 1) AS per_day FROM part")
def dose_parse(t):
    said = F.concat(F.col("p_size").cast("string"), F.lit(" mcg every "), (F.col("p_size") % 12 + 1).cast("string"), F.lit(" hours by mouth"))
    return t.part.select("p_partkey", clinical.dose_mg(said).alias("mg"), clinical.per_day(said).alias("per_day"))


@query("SELECT url_host AS host, count(*) AS n FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS url_host FROM pages) GROUP BY 1")
def path_dimensions(t):
    return t.pages.groupBy(F.regexp_extract("url", r"://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))
