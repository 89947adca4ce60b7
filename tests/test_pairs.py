"""Pairs, twins and the split search on small tables."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import pairs, search, twins


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_audit_lines(spark):
    for line, want in (("Renal: TRUE - true story", "Renal: FALSE - true story"), ("a: No", "a: Yes"), ("a: false", "a: true"), ("nothing", "nothing")):
        assert one(spark, pairs.flip_line(F.lit(line))) == want
    assert one(spark, pairs.one_line_diff(F.lit("a\nb"), F.lit("a\nc"))) and not one(spark, pairs.one_line_diff(F.lit("a\nb"), F.lit("a\nb\nc")))


def test_coherence(spark):
    flags = F.array(F.lit(False), F.lit(True))
    assert one(spark, pairs.coherent(F.lit(True), flags)) == "safe_with_true" and one(spark, pairs.coherent(F.lit(False), flags)) is None


def test_relabel_one_hot(spark):
    df = spark.createDataFrame([(1, [True, True, False]), (2, [True, False, False])], "k int, g array<boolean>")
    got = pairs.relabel_plan(df, "k", "g", "abc", "one_hot", 5, "s").collect()
    assert sorted((r.k, r.target, r.labels) for r in got) == [(1, "a", [True, False, False]), (1, "b", [False, True, False])]


def test_round_hands_shortfall_over(spark):
    pool = spark.createDataFrame([(i, "g", "x") for i in range(30)], "k int, g string, d string")
    have = spark.createDataFrame([("g", "x", 1)], "g string, d string, n int")
    got = pairs.plan_round(pool, have, "g", "d", "k", ("x", "y"), 10, "s").collect()
    assert len(got) == int((5 - 1 + 5) * 1.3) + 1


def test_twins(spark):
    rows = [(1, "Renal Impairment Risk", "CKD stage 4", "Asthma; CKD (since 2019), gout", "Gout with CKD"), (2, "Renal Impairment Risk", "CKD", None, "CKD"), (3, "Other", "x", "y", "z")]
    df = spark.createDataFrame(rows, ["id", "risk", "Renal Impairment", "Chronic Conditions", "Diagnosis"])
    made = twins.make(df, "id", "risk", {"Renal Impairment Risk": ["ckd"]}, clauses=["Diagnosis"])
    got = {r.id: r for r in made.collect()}
    assert set(got) == {"1c", "2c"}
    assert got["1c"]["Renal Impairment"].startswith("Normal renal function") and got["1c"]["Chronic Conditions"] == "Asthma" and got["1c"]["Diagnosis"] == "Gout"
    assert got["2c"]["Chronic Conditions"] is None and got["2c"]["Diagnosis"] == ""
    both = twins.interleave(df, made, "id", "risk").orderBy("Source_Key", F.desc("Sample_Role")).collect()
    assert [r.id for r in both] == ["1", "1c", "2", "2c"]
    assert one(spark, twins.prompt(F.lit("72.0"), F.lit("man"), F.lit(""), F.lit("A"), F.lit("5 mg"), F.lit("None."))) == "72-year-old man is prescribed A (5 mg). None. Is this safe?"


def test_split_search_is_disjoint_and_improves(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), bool(u), bool(a), bool(b)) for g, u, a, b in zip(rng.integers(0, 60, 1500), rng.random(1500) < 0.4, rng.random(1500) < 0.1, rng.random(1500) < 0.3)]
    stats = search.groups(spark.createDataFrame(rows, "g long, u boolean, a boolean, b boolean"), "g", F.col("u"), [F.col("a"), F.col("b")])

    def cost(at):
        held = {r["g"]: r for r in stats.collect()}
        size, uns, pos = np.zeros(3), np.zeros(3), np.zeros((3, 2))
        for r in at.collect():
            k = search.PARTS.index(r["part"])
            size[k] += held[r["g"]]["n"]
            uns[k] += held[r["g"]]["unsafe"]
            pos[k] += held[r["g"]]["pos"]
        return search._objective(np, size, pos, uns, search.SHARES)

    raw, fine = (search.search(stats, "g", 2, 30, "s", refine) for refine in (False, True))
    assert fine.count() == fine.select("g").distinct().count() == stats.count()
    best = search.scores(stats, "g", 2, 30, "s").agg(F.min("score")).first()[0]
    assert abs(cost(raw) - best) < 1e-6 and cost(fine) < cost(raw)


def test_probe_learns(spark):
    rows = [(i, "good clean words" if i % 2 else "spam spam offer", i % 2) for i in range(60)] + [(99, None, 0)]
    df = spark.createDataFrame(rows, "k int, t string, y int")
    got = search.probe(df.where("k < 40"), df.where("k >= 40"), "k", "t", "y", 1 << 10, 10).where("k < 99").collect()
    assert all(r.label == r.predicted for r in got) and len(got) == 20
