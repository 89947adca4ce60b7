"""The queries of the reference's sizes."""

import __spark_entry__ as e


def test_reference_sizes_are_registered(spark):
    sf = "/root/testdata/sf0.001"
    found = e.queries()
    assert found["bootstrap_ci_1000"](spark, sf).first().resamples == 1000
    assert found["split_search_scores_400"](spark, sf).count() == 400
    assert "range(0, 2000)" in e.oracle_sql()["paired_bootstrap_2000"] and sum(r.n for r in found["split_search_400"](spark, sf).collect()) == spark.read.parquet(f"{sf}/orders.parquet").count()
