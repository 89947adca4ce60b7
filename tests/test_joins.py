"""Running sums by ranges, joins with conflicts, versions of a compacted table, listings and schema gates."""

import pytest
from pyspark.sql import functions as F

from curatrix.operators import draws, joins, records, twins, validate
from curatrix.sources import files
from curatrix.streaming import incremental


def test_running_sums_and_positions(spark):
    rows = [(i * 7 % 101, float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(5)
    total, want = 0.0, {}
    for k, x in sorted(rows):
        total += x
        want[k] = total
    for parts in (1, 3, 16):
        assert {r.k: r.upto_x for r in joins.running(df, "k", ["x"], parts).collect()} == want
        assert {r.k: r.idx for r in joins.positions(df, "k", parts).collect()} == {k: k for k in range(101)}
    down = {r.k: r.upto_x for r in joins.running(df, "k", ["x"], 4, descending=True).collect()}
    assert all(down[k] == pytest.approx(5050.0 - want[k] + dict(rows)[k]) for k in down)


def test_conflicts_are_errors(spark):
    df = spark.createDataFrame([("id 1", "a"), ("id 2", "b"), ("id 2", "c"), ("none", "d")], "said string, v string")
    one, several = joins.extracted(df, "said", r"id (\d+)", "v")
    assert [tuple(r) for r in one.collect()] == [("1", "a")] and [tuple(r) for r in several.collect()] == [("2", 2)]
    with pytest.raises(ValueError, match="2"):
        joins.checked(one, several)
    assert joins.checked(one, several.limit(0)).count() == 1


def test_replaced_and_selected(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    other = spark.createDataFrame([(2, "x"), (3, None), (9, "z")], "k long, v string")
    new, counts = joins.replaced(df, other, "k", ["v"])
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "x"), (3, None)] and tuple(counts.first()) == (2, 1)
    ids = spark.createDataFrame([(3,), (2,), (2,)], "k long")
    assert [r.k for r in validate.select_rows(df, "k", 2, ids, 1).collect()] == [2]
    assert validate.same_schema(df, other) == [] and len(validate.same_schema(df, ids)) == 1


def test_versions_of_a_compacted_table(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    assert incremental.current(spark, path) is None
    schema = "k long, t long, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(source)
    run = lambda: incremental.compact(spark.readStream.schema(schema).parquet(source), "k", ("t",), path, str(tmp_path / "check")).awaitTermination()
    run()
    spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], schema).write.mode("append").parquet(source)
    run()
    assert sorted((r.k, r.v) for r in incremental.current(spark, path).collect()) == [(1, "c"), (2, "b"), (3, "d")]
    stream = incremental.windowed(spark.readStream.schema("ts timestamp, k long").parquet(source), "ts", "1 hour", "10 minutes", "k")
    assert stream.isStreaming and stream.columns == ["from", "k", "n"]


def test_listing_by_lines(spark, tmp_path):
    for name, n in (("a.jsonl", 2), ("b.jsonl", 5), ("c.txt", 9)):
        (tmp_path / name).write_text("x\n" * n)
    found = files.list_files(spark, str(tmp_path), 1, r".*\.jsonl")
    assert [(r.path.split("/")[-1], r.rows) for r in files.with_rows(found, 3).collect()] == [("b.jsonl", 5)]


def test_messages_and_draws(spark):
    message = spark.range(1).select(records.user_message({"Age": F.lit("4"), "Sex": F.lit("")}, F.lit("Is it safe?")).alias("m")).first().m
    assert message == "Patient profile:\n- Age: 4\n- Sex: Not reported\n\nScenario:\nIs it safe?"
    df = spark.createDataFrame([(i, f"g{i % 3}") for i in range(30)], "k long, g string")
    assert records.blind(df, ["g"]).columns == ["k"]
    known = spark.createDataFrame([(i, j) for i in range(8) for j in range(i)], "a long, b long")
    assert draws.unknown_pairs(known, "a", "b", 3, 5, "s").count() == 0
    pairs = draws.unknown_pairs(known.where("a + b <> 7"), "a", "b", 3, 3, "s").collect()
    assert len(pairs) == 3 and all(r.lo + r.hi == 7 for r in pairs)
    assert spark.range(1).select(twins.clause(F.lit("Gout with CKD"), F.array(F.lit("ckd"))).alias("x")).first().x == "Gout"


def test_longest_prefix(spark):
    from curatrix.operators import match

    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"])], "k long, w array<string>")
    names = spark.createDataFrame([("a",), ("a b",), ("b c",)], "name string")
    assert [tuple(r) for r in match.longest_prefix(F.col("w"), names, df, "k").collect()] == [(1, "a b")]


def test_alike_pairs_meet_their_cells_only(spark, tmp_path):
    """The pairs of the plain rule, by hand, from joins by name and by cell: none on the group alone, whose pairs are its square."""
    import re
    from itertools import combinations

    from curatrix.plans import registry

    numbers = [(1, 900.0), (2, 904.99), (2, 905.0), (3, 909.9999999), (0, -2.5), (1, 2.4999), (-1, 2.5), (2, -2.5), (1, float("nan")), (1, None), (None, 900.0), (50, 1e17), (50, 1e17 + 16), (1, 900.0), (1, 900.0)]
    rows = [(i, None if i % 7 == 6 else f"n{i % 4}", None if i == 20 else "b", f"t{i % 2}", *numbers[i % len(numbers)]) for i in range(45)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    none = lambda *x: any(v is None for v in x)
    near = lambda a, b: not none(a[4], b[4], a[5], b[5]) and abs(a[4] - b[4]) <= 1 and abs(a[5] - b[5]) < 5
    want = [(a[0], b[0], a[2], a[3]) for a, b in combinations(rows, 2) if not none(a[2], b[2]) and a[2:4] == b[2:4] and (a[1] is not None and a[1] == b[1] or near(a, b))]
    got = registry.queries()["weighted_pair_rule"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    joined = re.findall(r"Join \[([^\]]*)\], \[", got._jdf.queryExecution().executedPlan().toString())
    assert joined and all("p_name" in keys or "_at_" in keys for keys in joined)


def test_positions_of_many_rows(spark, tmp_path):
    """So many rows that ranges are drawn from a sample: the ends must be those of the totals, in every evaluation."""
    from curatrix.plans import registry

    n = 30000
    df = spark.range(0, n, 1, 6).select((F.col("id") * 7919 % n * 3).alias("k"), F.col("id").cast("string").alias("other"))
    for parts in (2, 8):
        placed = joins.positions(df, "k", parts)
        assert placed.where("idx <> k / 3").count() == 0 and placed.select("idx", "other").agg(F.count_distinct("idx"), F.max("idx")).first()[:] == (n, n - 1)
    down = joins.running(df.withColumn("one", F.lit(1)), "k", ["one"], 8, descending=True)
    assert down.where(f"upto_one <> {n} - k / 3").count() == 0
    labels = df.select(F.col("k").alias("doc_id"), (F.col("k") / 3 % 2).cast("int").alias("quality"))
    labels.union(spark.createDataFrame([(None, 1)], labels.schema)).write.parquet(str(tmp_path / "labels.parquet"))
    events = spark.range(-3, 2 * n).select(F.when(F.col("id") > -3, F.col("id")).alias("event_id"), F.when(F.col("id") % 2 == 1, 60.0).otherwise(40.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    # The row without an id is the last one, at position n; a negative or absent position is neither met nor out of range.
    assert registry.queries()["predictions_by_position"](spark, str(tmp_path)).collect() == [(n + 1, n, n - 1)]


@pytest.mark.parametrize(
    "name, table, made",
    [
        ("audit_diff", "orders", "SELECT i AS o_orderkey, CASE WHEN i % 5000 > 0 THEN i * 7919 % 3000 END AS o_custkey, (hash(i) % 49900000 + 100191) / 100.0 AS o_totalprice FROM range(30000) r(i)"),
        ("reward_mining", "events", "SELECT i AS event_id, i * 7919 % 400 AS user_id, (hash(i) % 10000) / 90.0 AS value FROM range(400 * 64) r(i)"),
    ],
)
def test_sums_in_order(spark, tmp_path, name, table, made):
    """Differences of 1 exactly and means that end in a half: rows in any order over any partitions give what SQL gives in order."""
    import duckdb

    from curatrix.plans import registry

    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create table {table} as {made}")
    con.execute(f"copy {table} to '{tmp_path}/ordered.parquet'")
    order = [c[0] for c in con.execute(f"describe {table}").fetchall()][0]
    spark.read.parquet(f"{tmp_path}/ordered.parquet").orderBy(F.md5(F.col(order).cast("string"))).repartition(7).write.parquet(f"{tmp_path}/{table}.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
