"""Signals on a dense grid, trades, equity and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_ticker, c, ratio
from .ranking import topn_per_date


def dense_grid(df: DataFrame) -> DataFrame:
    """Every ticker on every date of the panel. The calendar travels as one sorted array, bounded by the number of days,
    and each ticker expands it."""
    cal = df.select("date").distinct().groupBy().agg(F.sort_array(F.collect_list("date")).alias("_days")).withColumn("_all", F.lit(0))
    names = df.select("ticker").distinct().withColumn("_all", F.lit(0))
    return names.join(F.broadcast(cal), "_all").select("ticker", F.explode("_days").alias("date"))


def signal_grid(df: DataFrame, signals: DataFrame, signal: str = "signal") -> DataFrame:
    """The dense grid with the signal where there is one and 0 elsewhere."""
    return dense_grid(df).join(signals.select("ticker", "date", signal), ["ticker", "date"], "left").withColumn(
        signal, F.coalesce(signal, F.lit(0)))


def price_grid(df: DataFrame) -> DataFrame:
    """Dense close prices, carried forward over dates without a bar."""
    d = dense_grid(df).join(df.select("ticker", "date", "close"), ["ticker", "date"], "left")
    return d.withColumn("close", F.last("close", ignorenulls=True).over(by_ticker(None, 0)))


def event_long_signals(df: DataFrame, threshold: float = 0.5, n: int = 20) -> DataFrame:
    """Predicted events with enough probability, the top ``n`` probabilities per date, kept where direction is up."""
    p = c("event_prob")
    d = df.where((c("event_pred") == 1) & (p >= threshold) & ~F.isnan(p))
    return topn_per_date(d, "event_prob", n, "event_rank").where(c("direction_pred") == 1)


def baseline_signals(df: DataFrame, trigger: float = 0.5, min_return: float = 1.0, max_drawdown: float = -3.0, n: int = 20,
                     band: float = 0.01) -> DataFrame:
    """Rows passing the three prediction limits, top ``n`` scores per date, decided 1, -1 or 0 by the sign of the score.
    Decision 0 is an exit, anything else an entry."""
    ok = (c("trigger_prob") >= trigger) & (c("expected_return") >= min_return) & (c("expected_drawdown") >= max_drawdown)
    d = topn_per_date(df.where(ok), "policy_score", n, "signal_rank")
    s = c("policy_score")
    return d.withColumn("decision", F.when(s > band, 1).when(s < -band, -1).otherwise(0))


def full_signals(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """Bars with predictions where known; only LONG keeps a size, between 0 and 1."""
    d = df.join(predictions, ["ticker", "date"], "left").fillna({"action": "FLAT", "position_size": 0.0, "policy_score": 0.0})
    size = F.least(F.greatest(c("position_size"), F.lit(0.0)), F.lit(1.0))
    return d.withColumn("position_size", F.when(c("action") == "LONG", size).otherwise(0.0))


def trades_long_flat(df: DataFrame, signal: str = "signal", fee: float = 0.001) -> DataFrame:
    """One row per trade: bought at the close where the signal turns to 1, sold at the close of the first 0 after it, or
    marked at the last close while still open. A fee is paid on each side."""
    on = (c(signal) == 1).cast("int")
    d = df.withColumn("_on", on)
    d = d.withColumn("_was", F.coalesce(F.lag("_on").over(by_ticker()), F.lit(0)))
    d = d.withColumn("_trade", F.sum(F.when((c("_on") == 1) & (c("_was") == 0), 1).otherwise(0)).over(by_ticker(None, 0)))
    d = d.where((c("_on") == 1) | (c("_was") == 1))
    t = d.groupBy("ticker", F.col("_trade").alias("trade")).agg(
        F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry_price"), F.max("date").alias("exit_date"),
        F.max_by("close", "date").alias("exit_price"), F.sum("_on").alias("bars"), F.min("_on").alias("_last"))
    gain = F.try_divide(c("exit_price") * (1 - fee), c("entry_price") * (1 + fee)) - 1
    return t.withColumns({"open": F.when(c("_last") == 1, 1).otherwise(0), "return": gain}).withColumn(
        "win", F.when(c("return") > 0, 1).otherwise(0)).drop("_last")


def equity_curve(df: DataFrame, signal: str = "signal", fee: float = 0.001, cash: float = 10_000.0) -> DataFrame:
    """Equity per ticker: returns count while the signal of the bar before was 1, fees where the position changes. A price of
    0 while a position is held ends the equity at 0."""
    d = df.withColumn("_pos", F.when(c(signal) == 1, 1).otherwise(0))
    d = d.withColumns({"_held": F.coalesce(F.lag("_pos").over(by_ticker()), F.lit(0)), "_pc": F.lag("close").over(by_ticker())})
    step = F.when(c("_held") == 1, F.coalesce(ratio("close", "_pc"), F.lit(1.0))).otherwise(1.0)
    cost = F.when((c("_pos") == 1) & (c("_held") == 0), 1 / (1 + fee)).when((c("_pos") == 0) & (c("_held") == 1), 1 - fee).otherwise(1.0)
    d = d.withColumn("_step", step * cost)
    d = d.withColumns({"_ln": F.when(c("_step") > 0, F.ln("_step")), "_lost": (c("_step") <= 0).cast("int"), "held": c("_held")})
    grown = cash * F.exp(F.coalesce(F.sum("_ln").over(by_ticker(None, 0)), F.lit(0.0)))
    d = d.withColumn("equity", F.when(F.max("_lost").over(by_ticker(None, 0)) == 1, 0.0).otherwise(grown))
    d = d.withColumn("peak", F.greatest(F.max("equity").over(by_ticker(None, 0)), F.lit(cash)))
    return d.withColumn("drawdown", c("equity") / c("peak") - 1).drop("_pos", "_held", "_pc", "_step", "_ln", "_lost")


def perf_basic(df: DataFrame) -> DataFrame:
    """First and last price, total return, rows, span and action counts per ticker."""
    s = df.groupBy("ticker").agg(
        F.min_by("close", "date").alias("initial_price"), F.max_by("close", "date").alias("final_price"), F.count("*").alias("rows"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        *[F.count_if(c("action") == a).alias(f"{a.lower()}_signals") for a in ("LONG", "SHORT", "FLAT")])
    return s.withColumn("total_return_pct", (ratio("final_price", "initial_price") - 1) * 100)


def perf_stats(df: DataFrame, signal: str = "signal", fee: float = 0.001, cash: float = 10_000.0, periods: int = 52) -> DataFrame:
    """Per ticker: equity, drawdown, Sharpe ratio, buy and hold, exposure and trade statistics."""
    curve = equity_curve(df, signal, fee, cash)
    prev = F.coalesce(F.lag("equity").over(by_ticker()), F.lit(cash))
    curve = curve.withColumn("_r", c("equity") / prev - 1)
    e = curve.groupBy("ticker").agg(
        F.max_by("equity", "date").alias("equity_final"), F.greatest(F.max("equity"), F.lit(cash)).alias("equity_peak"),
        (F.min("drawdown") * 100).alias("max_drawdown_pct"), (F.avg("held") * 100).alias("exposure_pct"),
        (F.try_divide(F.avg("_r"), F.stddev_samp("_r")) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        ((F.max_by("close", "date") / F.min_by("close", "date") - 1) * 100).alias("buy_hold_pct"))
    r = c("return")
    t = trades_long_flat(df, signal, fee).groupBy("ticker").agg(
        F.count("*").alias("trades"), (F.avg("win") * 100).alias("win_rate_pct"), (F.max(r) * 100).alias("best_trade_pct"),
        (F.min(r) * 100).alias("worst_trade_pct"), (F.avg(r) * 100).alias("avg_trade_pct"),
        F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))).alias("profit_factor"))
    out = e.join(t, "ticker", "left").withColumn("trades", F.coalesce("trades", F.lit(0)))
    return out.withColumn("return_pct", (c("equity_final") / cash - 1) * 100)
