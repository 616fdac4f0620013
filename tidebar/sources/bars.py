"""Bar panels derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import evened, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_start(d):
    d = d.cast("date")
    return F.date_sub(d, F.weekday(d))


def line_order():
    """Order of the line items of one week as one number: weekday, order, line, part, price in cents.

    A struct would say the same, but hash aggregation keeps only flat values, and a struct would make it sort every line
    item first. Keys beyond the digits given to them raise an overflow error.
    """
    near = F.weekday(F.col("l_shipdate").cast("date")).cast("long") * 10**15 + F.col("l_orderkey") * 100 + F.col("l_linenumber")
    far = F.col("l_partkey").cast("decimal(11,0)") * F.lit(10**10).cast("decimal(11,0)") + F.round(F.col("l_extendedprice") * 100).cast("decimal(10,0)")
    return (near.cast("decimal(16,0)") * F.lit(10**11).cast("decimal(12,0)") * F.lit(10**10).cast("decimal(11,0)") + far).cast("decimal(38,0)")


def bars(spark: SparkSession, sf_dir: str, dims: bool = False) -> DataFrame:
    """Weekly open/high/low/close/volume bars, one series per supplier; with ``dims`` also market, exchange and currency.

    The grouping combines on the map side, so a supplier holding most of the line items still sends only one partial
    row per week and task; line items in large file splits are rebalanced before it. Afterwards (ticker, date) is unique, and the bars are dealt by ticker for the windows over them.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate",
                                                 week_start(F.col("l_shipdate")).alias("date"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    weekly = (
        evened(li, "l_suppkey", "date")
        .select("l_suppkey", "date", price.alias("px"), line_order().alias("o"), "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("paid"))
        .groupBy("l_suppkey", "date")
        .agg(
            F.min_by("px", "o").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "o").alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("paid").cast("double").alias("turnover"),
        )
    )
    out = weekly.select(
        "l_suppkey", F.format_string("S%09d", "l_suppkey").alias("ticker"), "date", "open", "high", "low", "close",
        "volume", "turnover", F.year("date").alias("year"),
    )
    if not dims:
        return spread(out.drop("l_suppkey"))
    where = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("market"), F.col("n_name").alias("exchange"))
    )
    return spread(out.join(where, "l_suppkey").drop("l_suppkey").withColumn("currency", F.lit("USD")))


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values, one series per event type."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour"), "value",
        F.struct("ts", "event_id").alias("o"),
    )
    return ev.groupBy("ticker", "hour").agg(
        F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "o").alias("close"), F.count("*").alias("volume"),
    )
