"""Derived inputs that several queries share, in Spark and in SQL.

Scores stand in for model output: arithmetic on the row number, close and volume, so that both engines get the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import SERIES
from ..operators import labels as lab
from ..operators.features import atr_v1
from ..operators.regime_block import m002_features
from ..operators.regimes import regime_label
from ..sources.bars import bars, table, tick_bars  # noqa: F401
from .sql_panel import F1, step

SCORES = {
    "prob": "CAST((rn * 37 + CAST(floor(close) AS BIGINT)) % 101 AS DOUBLE) / 100",
    "exp_ret": "CAST((rn * 17 + CAST(floor(volume * 3) AS BIGINT)) % 41 AS DOUBLE) / 4 - 2.5",
    "exp_dd": "CAST((rn * 13 + CAST(floor(close * 7) AS BIGINT)) % 29 AS DOUBLE) / -5",
    "peak": "CAST((rn * 11 + CAST(floor(close) AS BIGINT)) % 97 AS DOUBLE) / 96",
}


def scored(df: DataFrame) -> DataFrame:
    """Add prob, exp_ret, exp_dd and peak to a panel."""
    d = df.withColumn("rn", F.expr(f"row_number() OVER ({SERIES})"))
    return d.withColumns({k: F.expr(e) for k, e in SCORES.items()})


def sql_scored(name: str, src: str) -> None:
    step(f"{name}_rn", src, rn="row_number() OVER w")
    step(name, f"{name}_rn", **SCORES)


sql_scored("sc", "bars")
sql_scored("scm", "m002")


def scores(spark, sf) -> DataFrame:
    return scored(bars(spark, sf))


def regime_scores(spark, sf) -> DataFrame:
    """The regime block with scores."""
    return scored(m002_features(bars(spark, sf)))


def labelled(spark, sf, horizon: int = 1, thresh: float = 0.5) -> DataFrame:
    return lab.label_cls(bars(spark, sf), horizon, thresh)


step("lab0", "bars", futret_1="lead(close, 1) OVER w / close - 1", futret_5="lead(close, 5) OVER w / close - 1")
step("lab", "lab0", label_1d_cls="CASE WHEN futret_1 >= 0.5 THEN 1 WHEN futret_1 <= -0.5 THEN -1 ELSE 0 END",
     label_5d_cls="CASE WHEN futret_5 >= 0.5 THEN 1 WHEN futret_5 <= -0.5 THEN -1 ELSE 0 END")


def big_moves(spark, sf) -> DataFrame:
    """Bars with the big-move label."""
    d = atr_v1(bars(spark, sf)).select("ticker", "date", "open", "high", "low", "close", "volume", "turnover", "atr14")
    return lab.label_big_move(d)


step("bm0", "v1", next_range="greatest(abs(lead(high) OVER w / lead(open) OVER w - 1), abs(lead(open) OVER w / lead(low) OVER w - 1))",
     atr_share="CASE WHEN atr14 > 0 AND close <> 0 THEN atr14 / close ELSE 0.05::DOUBLE END")
step("bm", "bm0", big_move_event=F1("next_range >= 0.8::DOUBLE * atr_share"))


def regimes(spark, sf) -> DataFrame:
    return regime_label(m002_features(bars(spark, sf)))
