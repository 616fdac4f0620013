"""Forward-looking labels. Windows reach ahead inside one ticker only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_ticker, c, lead, ratio


def future_return(df: DataFrame, horizon: int = 5) -> DataFrame:
    return df.withColumn(f"futret_{horizon}", ratio(lead("close", horizon), c("close")) - 1)


def label_cls(df: DataFrame, horizon: int = 5, thresh: float = 0.05) -> DataFrame:
    """1 above the threshold, -1 below its negative, else 0; a missing return counts as 0."""
    d = df if f"futret_{horizon}" in df.columns else future_return(df, horizon)
    r = c(f"futret_{horizon}")
    return d.withColumn(f"label_{horizon}d_cls", F.when(r >= thresh, 1).when(r <= -thresh, -1).otherwise(0))


def future_return_labels(df: DataFrame, horizon: int = 5, task: str = "regression", thresh: float = 0.05) -> DataFrame:
    if task not in ("regression", "classification"):
        raise ValueError(f"unknown task: {task}")
    d = future_return(df, horizon)
    return d if task == "regression" else label_cls(d, horizon, thresh)


def ret_dd(df: DataFrame, horizon: int = 5) -> DataFrame:
    """Return in percent over the horizon and worst close on the way, relative to today; a short tail still has a worst close."""
    worst = F.min("close").over(by_ticker(0, horizon))
    return df.withColumns({
        f"ret_{horizon}d_pct": (ratio(lead("close", horizon), c("close")) - 1) * 100,
        f"dd_{horizon}d_pct": (ratio(worst, c("close")) - 1) * 100,
    })


def label_rebound(df: DataFrame, horizon: int = 5, rebound: float = 1.0, floor: float = -3.0) -> DataFrame:
    d = df if f"ret_{horizon}d_pct" in df.columns else ret_dd(df, horizon)
    ok = (c(f"ret_{horizon}d_pct") >= rebound) & (c(f"dd_{horizon}d_pct") >= floor)
    return d.withColumn("label_rebound_bin", F.when(ok, 1).otherwise(0))


def label_big_move(df: DataFrame, k: float = 0.8) -> DataFrame:
    """1 when the next bar of the same ticker moves at least k times the true range share of the close."""
    up, down = ratio(lead("high"), lead("open")) - 1, ratio(lead("open"), lead("low")) - 1
    share = F.when((c("atr14") > 0) & (c("close") != 0), ratio("atr14", "close")).otherwise(0.05)
    d = df.withColumns({"next_range": F.greatest(F.abs(up), F.abs(down)), "atr_share": share})
    return d.withColumn("big_move_event", F.when(c("next_range") >= k * c("atr_share"), 1).otherwise(0))
