"""Rolling operators over series that are cut into ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_panels import day, local, make_panel
from tidebar.operators import features as f
from tidebar.operators.ordered import pinned
from tidebar.operators.ranges import in_ranges, range_map


@pytest.fixture(scope="module")
def lopsided(spark):
    """One ticker with over 90 percent of the rows, a gap of years, and short ones."""
    d = make_panel(spark, {"A": 6000, "B": 300, "C": 1, "D": 40}, gaps=True)
    return pinned(d.withColumn("date", F.expr("CASE WHEN ticker = 'B' AND day(date) > 15 THEN date + INTERVAL 9 YEARS ELSE date END").cast("date")).dropDuplicates(["ticker", "date"]))


@pytest.mark.parametrize("rows,unit", [(100, "month"), (7, "day"), (10**6, "year")])
def test_ranges_change_nothing(lopsided, rows, unit):
    for fn, halo, cols in ((f.atr_v1, 15, ["atr5", "atr10", "atr14"]), (f.stoch_v2, 16, ["stochk14", "stochd14"]), (f.cci20, 39, ["cci20"]), (f.volume_v2, 20, ["vol_z20", "vol_roc5"])):
        a, b = local(fn(lopsided)), local(in_ranges(lopsided, fn, halo, rows, unit))
        assert len(a) == len(b) and list(b["ticker"]) == list(a["ticker"]) and list(a.columns) == list(b.columns)
        for k in cols:
            np.testing.assert_allclose(a[k].to_numpy(float), b[k].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_no_task_gets_over_twice_its_share(spark, lopsided):
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # tasks this small would be joined
    held = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        n, whole = ([r["n"] for r in df.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.sum("atr14")).collect()]
                    for df in (in_ranges(lopsided, f.atr_v1, 15, rows=100), f.atr_v1(lopsided)))
    finally:
        spark.conf.set(key, held)
    assert sum(n) == sum(whole) == lopsided.count()
    assert max(n) <= 2 * sum(n) / 8 and max(whole) > 0.9 * sum(n)


def test_a_bucket_is_read_by_the_ranges_that_need_it(spark):
    d = spark.createDataFrame([("A", day(i)) for i in range(10)], "ticker string, date date")
    got = sorted((r["_bucket"].date(), r["_part"], r["own__"]) for r in range_map(d, halo=3, rows=2, unit="day").collect())
    for i in range(10):
        assert [(p, own) for b, p, own in got if b == day(i)] == [(p, p == i // 2) for p in range(5) if p == i // 2 or p > i // 2 and i >= 2 * p - 3]


def test_bars_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    """No task holds many more bars than asked for, however narrow they are, and a ticker stays in one."""
    from tidebar.operators import ranges
    from tidebar.operators.explorer import x_returns
    from tidebar.sources.bars import bars

    monkeypatch.setattr(ranges, "TASK_BARS", 100)
    items = spark.range(4000).selectExpr("id AS l_orderkey", "1L AS l_linenumber", "1L AS l_partkey", "id % 80 AS l_suppkey", "CAST(1 AS DOUBLE) AS l_quantity",
                                         "CAST(id AS DOUBLE) AS l_extendedprice", "date_add(DATE'1995-01-02', CAST(7 * (id div 80) AS INT)) AS l_shipdate")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    d = local(x_returns(bars(spark, str(tmp_path))).withColumn("task", F.spark_partition_id()).select("ticker", "date", "task"))
    assert len(d) == 4000
    assert d.groupby("task").size().max() <= 500
    assert (d.groupby("ticker")["task"].nunique() == 1).all()


def test_large_splits_are_rebalanced_before_their_groups(spark, tmp_path, monkeypatch):
    """The groups that a task combines are bounded by rows, not by the split of the file; small splits stay as read, and bars are the same."""
    from tidebar.operators import ranges
    from tidebar.sources.bars import bars

    items = spark.range(6000).selectExpr("id AS l_orderkey", "1L AS l_linenumber", "1L AS l_partkey", "IF(id % 3 = 0, 7L, id % 80) AS l_suppkey", "CAST(1 + id % 5 AS DOUBLE) AS l_quantity",
                                         "CAST(id AS DOUBLE) AS l_extendedprice", "date_add(DATE'1995-01-02', CAST(id div 80 AS INT)) AS l_shipdate")
    items.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = spark.read.parquet(str(tmp_path / "lineitem.parquet"))
    largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    want = local(bars(spark, str(tmp_path)))
    assert largest(ranges.evened(rows, "l_suppkey", "l_shipdate")) == 6000
    monkeypatch.setattr(ranges, "TASK_ROWS", 1000)
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # tasks this small would be joined
    held = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert largest(ranges.evened(rows, "l_suppkey", "l_shipdate")) <= 2000
        assert largest(ranges.evened(rows.repartition(8), "l_suppkey", "l_shipdate")) <= 1000
        got = local(bars(spark, str(tmp_path)))
    finally:
        spark.conf.set(key, held)
    assert len(got) == len(want) and (got.values == want.values).all()
