"""Holds every query with SQL against DuckDB: python tests/compare.py [folder] [name...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b) -> str:
    import numpy as np

    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    cols = sorted(a.columns)
    sort = lambda d: d[cols].astype(object).where(d[cols].notna(), None).sort_values(cols, key=lambda s: s.map(lambda v: repr(round(v, 5)) if isinstance(v, float) else str(v))).reset_index(drop=True)
    a, b = sort(a), sort(b)
    for c in cols:
        for x, y in zip(a[c], b[c]):
            if isinstance(x, float) or isinstance(y, float):
                if (x is None) != (y is None) or (x is not None and not np.isclose(float(x), float(y), rtol=1e-9, atol=1e-9)):
                    return f"{c}: {x!r} {y!r}"
            elif x != y and str(x) != str(y):
                return f"{c}: {x!r} {y!r}"
    return ""


def run(spark, sf: str, names=()) -> dict[str, str]:
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = {}
    for name, f in e.queries().items():
        if names and name not in names or not names and (name.startswith("op") or name == "pipeline"):
            continue
        at = time.time()
        try:
            got = f(spark, sf).toPandas()
            sql = e.oracle_sql().get(name)
            why = same(got, con.execute(sql).df()) if sql else ""
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:300]}"
        print(name, round(time.time() - at, 1), why or "ok", flush=True)
        if why:
            bad[name] = why
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(run(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
