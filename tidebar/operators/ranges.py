"""Rolling operators over series of any length: one series is cut into ranges that are worked on side by side.

A window over a ticker puts the whole series into one task. An operator that looks back a bounded number of rows needs only
its range and that many rows before it, the halo. Rows are counted per (ticker, calendar bucket) by a hash aggregate; running
sums over these few counts give every bucket its range and the later ranges whose halo it belongs to; the rows join this small
table and are repeated for those ranges only. The operator then runs with one series per range, and the halo is dropped.

Results equal those of the whole series if the operator looks back at most ``halo`` rows; running sums, forward fills and
exponential means do not. A range has ``rows`` rows, or one more bucket; a bucket is never cut, so its unit should hold far
fewer rows than a range.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_map(df: DataFrame, halo: int, rows: int, unit: str = "month") -> DataFrame:
    """(ticker, _bucket, _part, own__): the ranges that read a bucket; ``own__`` marks the one it belongs to."""
    counts = df.groupBy("ticker", F.date_trunc(unit, "date").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("ticker").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    b = b.withColumn("_range", F.floor(F.col("_before") / rows))
    starts = b.groupBy("ticker", F.col("_range").alias("_part")).agg(F.min("_before").alias("_start"))
    last = F.greatest(F.col("_range"), F.ceil((F.col("_before") + F.col("_n") + halo) / rows) - 1)
    reads = b.withColumn("_part", F.explode(F.sequence("_range", last))).join(starts, ["ticker", "_part"])
    own = F.col("_part") == F.col("_range")
    near = F.col("_before") + F.col("_n") > F.col("_start") - halo
    return reads.where(own | near).select("ticker", "_bucket", "_part", own.alias("own__"))


def in_ranges(df: DataFrame, fn: Callable[[DataFrame], DataFrame], halo: int, rows: int = 100_000, unit: str = "month") -> DataFrame:
    """``fn(df)`` for an operator that looks back at most ``halo`` rows of a ticker, with long series spread over tasks."""
    reads = range_map(df.select("ticker", "date"), halo, rows, unit)
    d = df.withColumn("_bucket", F.date_trunc(unit, "date")).join(reads, ["ticker", "_bucket"])
    d = d.withColumns({"series__": F.col("ticker"), "ticker": F.concat_ws("\u0000", "ticker", F.col("_part").cast("string"))}).drop("_bucket", "_part")
    out = fn(d).where("own__")
    return out.withColumn("ticker", F.col("series__")).drop("series__", "own__")


#: Bars that one task holds: some hundred columns of features over them are sorted several times in one stage.
TASK_BARS = 200_000


#: Rows that one task reads before an aggregate that combines them on the map side.
TASK_ROWS = 1_000_000


def evened(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Rows for an aggregate by ``keys`` that combines on the map side: as read if no split has more than ``rows`` (``TASK_ROWS``).

    Such an aggregate holds all groups of its split, and splits grow with the files. Larger ones are rebalanced by the keys, which
    keeps the combining; adaptive execution cuts the share of a frequent key into tasks of its advisory size.
    """
    rows, n = rows or TASK_ROWS, df.count()
    if n <= rows or df.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count")).first()[0] <= rows:
        return df
    return df.hint("rebalance", ceil(n / rows), *keys)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A panel dealt by ticker over so many tasks that one holds about ``rows`` bars (``TASK_BARS``), whatever the number of tickers.

    Feature blocks widen a panel behind its shuffle, so partitions that are sized by the bytes of the narrow bars hold far too
    many rows. Windows over a ticker, and groups within one, keep the partitions given here. The bars are counted when this is
    called; only the keys are computed for that. A panel too small for that still keeps every core busy.
    """
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(ceil(n / (rows or TASK_BARS)), min(cores, ceil(n / 5_000)), 1), "ticker")
