"""Joins, memberships and summaries of whole panels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import c

PANEL = ["ticker", "date"]
#: Statistics a summary can take, by the name that ends the column.
STATS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def join_panels(base: DataFrame, *others: DataFrame, fill: dict | None = None) -> DataFrame:
    """All rows of ``base`` with the columns of the other panels, matched by ticker and date; ``fill`` replaces what is missing.
    The other panels have one row per ticker and date."""
    out = base
    for other in others:
        out = out.join(other, PANEL, "left")
    return out.fillna(fill) if fill else out


def in_list(df: DataFrame, listed: DataFrame, key: str = "ticker", inside: bool = True) -> DataFrame:
    """Rows whose key is in a list, or is not; a key that the list repeats counts once and a null key is in no list."""
    return df.join(listed.select(key), key, "left_semi" if inside else "left_anti")


def sector_table(spark: SparkSession, sectors: dict[str, Iterable[str]]) -> DataFrame:
    """A map of sectors to tickers as distinct (ticker, sector) rows; a ticker may be in several sectors."""
    rows = sorted({(str(t).strip().upper(), s) for s, tickers in sectors.items() for t in tickers})
    return spark.createDataFrame(rows, "ticker string, sector string")


def join_sectors(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """Every row once per sector of its ticker; rows of tickers without a sector go."""
    return df.join(sectors.select("ticker", "sector").distinct(), "ticker")


def sector_summary(df: DataFrame, sectors: DataFrame, value: str = "turnover") -> DataFrame:
    """Rows, tickers and the exact total of a money column per sector."""
    total = F.sum(c(value).cast("decimal(18,2)")).cast("double").alias(value)
    return join_sectors(df.select("ticker", value), sectors).groupBy("sector").agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"), total)


def class_rates(df: DataFrame, label: str, rates: dict[str, int | None], by: str = "date") -> DataFrame:
    """Share of rows per date with a class of the label: ``{"up_rate": 1}``; None stands for any class but 0."""
    y = c(label)
    return df.groupBy(by).agg(*[F.avg((y != 0 if k is None else y == k).cast("double")).alias(name) for name, k in rates.items()])


def summary(df: DataFrame, stats: dict[str, Iterable[str]], by: str = "ticker") -> DataFrame:
    """Statistics of columns per ticker: ``{"close": ["mean", "std"]}`` gives close_mean and close_std."""
    return df.groupBy(by).agg(*[STATS[s](k).alias(f"{k}_{s}") for k, names in stats.items() for s in names])


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value of a column with few values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def rising_share(df: DataFrame) -> DataFrame:
    """Bars, bars that closed above their open, and their share, for tickers that have any such bar."""
    d = df.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(c("close") > c("open")).alias("up")).where("up > 0")
    return d.withColumn("share", c("up") / c("n"))


def market_state(df: DataFrame, out: str = "state") -> DataFrame:
    """UP on dates when most bars closed above their open, else DOWN."""
    return df.groupBy("date").agg(F.when(F.count_if(c("close") > c("open")) * 2 > F.count("*"), "UP").otherwise("DOWN").alias(out))


def state_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """The states of two markets on the dates that both have, and whether they agree."""
    d = market_state(a, "state_a").join(market_state(b, "state_b"), "date")
    return d.withColumn("same", c("state_a") == c("state_b"))


def distinct_values(df: DataFrame, columns: Iterable[str] = PANEL) -> DataFrame:
    """(kind, value): the distinct values of each column as text."""
    out = None
    for k in columns:
        d = df.select(k).distinct().select(F.lit(k).alias("kind"), c(k).cast("string").alias("value"))
        out = d if out is None else out.unionByName(d)
    return out
