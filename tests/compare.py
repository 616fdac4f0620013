"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").appName("tidebar")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple("~" if (v is None or v != v) else (repr(float(v)) if isinstance(v, float) else str(v)) for v in row))
    return sorted(rows)


def compare(spark, con, key: str, sf_dir: str, queries, oracles) -> str:
    t = time.time()
    got = queries[key](spark, sf_dir).toPandas()
    took = time.time() - t
    if key not in oracles:
        return f"rows {len(got)} {took:.1f}s"
    t = time.time()
    want = con.execute(oracles[key]).df()
    slow = f" {took:.1f}s/{time.time() - t:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} {sorted(want.columns)}"
    kinds = {k: (got[k].dtype.kind, want[k].dtype.kind) for k in got.columns if got[k].dtype.kind != want[k].dtype.kind
             and {got[k].dtype.kind, want[k].dtype.kind} - {"O", "U", "T"}}
    if kinds:
        return f"FAIL types {kinds}{slow}"
    a, b = norm(got), norm(want)
    if a == b:
        return f"ok {len(a)}{slow}"
    if len(a) != len(b):
        return f"FAIL rows {len(a)} {len(b)}{slow}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"FAIL {len(bad)} of {len(a)} differ{slow}\n   " + "\n   ".join(f"{x}\n   {y}" for x, y in bad[:3])


def main() -> None:
    import __spark_entry__ as e

    sf_dir = sys.argv[1]
    q, o = e.queries(), e.oracle_sql()
    keys = sys.argv[2:] or list(q)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            res = compare(spark, con, k, sf_dir, q, o)
        except Exception as ex:  # noqa: BLE001
            res = f"FAIL {type(ex).__name__} {str(ex)[:1500]}"
        bad += res.startswith("FAIL")
        print(f"{k}: {res}", flush=True)
    print(f"{len(keys)} checked, {bad} bad")


if __name__ == "__main__":
    main()
