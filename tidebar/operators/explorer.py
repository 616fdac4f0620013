"""Second feature definition, used for event and episode analysis. Columns start with ``x_``: several share a name with
the regime block but are computed differently (population deviations, Wilder smoothing, shorter warm-up)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import (
    SERIES, c, change, clip, diff, drop_temps, flag, ratio, rmean, rolling, rquantile, rstdp, zroll,
)
from .ewm import ewm, span
from .features import terms

EVENT_ORDER = ["x_event_local_vol_spike", "x_event_rebound_candidate", "x_event_volume_regain", "x_event_exhaustion_candidate",
               "x_event_breakdown_risk"]


def x_returns(df: DataFrame) -> DataFrame:
    d = df.withColumns({"x_return": change("close"), "x_vol_roc": change("volume"),
                        "x_log_return": F.expr(f"ln(try_divide(nullif(close, 0D), lag(close) OVER ({SERIES})))")})
    return d.withColumn("x_vol_roc_neg", F.when(c("x_vol_roc") < 0, 1.0).otherwise(0.0))


def x_ema_macd(df: DataFrame) -> DataFrame:
    d = ewm(df, {f"{p}ema_{n}": ("close", span(n)) for p, n in (("x_", 5), ("x_", 20), ("_x", 12), ("_x", 26))})
    d = d.withColumns({"x_ema_spread": c("x_ema_5") - c("x_ema_20"), "x_macd": c("_xema_12") - c("_xema_26")})
    d = ewm(d, {"x_macd_signal": ("x_macd", span(9))})
    return d.withColumns({"x_macd_hist": c("x_macd") - c("x_macd_signal"), "x_delta_macd": diff("x_macd"),
                          "x_delta_ema_spread": diff("x_ema_spread")})


def _wilder_strength(gain: str, loss: str):
    g, s = c(gain), c(loss)
    value = F.when(s == 0, F.when(g > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(g, s)))
    return clip(value, 0.0, 100.0)


def x_wilder(df: DataFrame) -> DataFrame:
    """Wilder-smoothed strength over 14 and 7 bars and true range over 14, in one pass of exponential means."""
    d = terms(df).withColumns({"_xg": F.greatest(c("_chg"), F.lit(0.0)), "_xs": F.greatest(-c("_chg"), F.lit(0.0))})
    d = d.withColumns({k: F.when(c("_chg").isNotNull(), c(k)) for k in ("_xg", "_xs")})
    d = ewm(d, {"_xg14": ("_xg", 1 / 14), "_xs14": ("_xs", 1 / 14), "_xg7": ("_xg", 1 / 7), "_xs7": ("_xs", 1 / 7), "x_atr_14": ("_tr", 1 / 14)},
            {"_xg14": 14, "_xs14": 14, "_xg7": 7, "_xs7": 7})
    d = d.withColumns({f"x_rsi_{n}": _wilder_strength(f"_xg{n}", f"_xs{n}") for n in (14, 7)})
    return d.withColumns({"x_delta_rsi": diff("x_rsi_14"), "x_delta_rsi_3": diff("x_rsi_14", 3), "x_delta_atr_3": diff("x_atr_14", 3),
                          "x_delta_atr_5": diff("x_atr_14", 5)})


def x_bollinger(df: DataFrame) -> DataFrame:
    d = df.withColumns({"x_bb_mid": rmean("close", 20), "_xsd": rstdp("close", 20)})
    d = d.withColumns({"x_bb_upper": c("x_bb_mid") + 2 * c("_xsd"), "x_bb_lower": c("x_bb_mid") - 2 * c("_xsd")})
    d = d.withColumn("_xbw", c("x_bb_upper") - c("x_bb_lower"))
    d = d.withColumns({"x_pos_in_band": F.when(F.abs("_xbw") > 1e-9, clip(ratio("close - x_bb_lower", "_xbw"), 0.0, 1.0)),
                       "x_bb_width": ratio("_xbw", "x_bb_mid")})
    return d.withColumn("x_bb_width_delta_5", change("x_bb_width", 5))


def x_scores(df: DataFrame) -> DataFrame:
    """Rolling z-scores of volume and strength, interactions, volatility ratio and relatives."""
    d = df.withColumns({
        "x_volume_z": zroll("volume", 60), "x_rsi_local_z": zroll("x_rsi_14", 20), "x_local_vol_index": ratio(rstdp("x_return", 5), rstdp("x_return", 20)),
        "x_atr_over_ema20": ratio("x_atr_14", "x_ema_20"), "x_delta_rsi_x_delta_macd": c("x_delta_rsi_3") * c("x_delta_macd"),
        "x_delta_ema_spread_x_delta_atr": c("x_delta_ema_spread") * c("x_delta_atr_5"),
        "x_trend_momentum_divergence": c("x_macd") - c("x_rsi_14"),
        "x_volume_adjusted_atr": ratio("x_atr_14", "ln(nullif(volume, 0D))"),
        "x_ema_atr_corr_20": rolling("corr(x_ema_5, ?)", "x_atr_14", 20),
        "x_pos_in_band_rel": ratio("close - x_bb_mid", "_xbw"), "x_atr_rel": ratio(c("x_atr_14"), rmean("x_atr_14", 20, 5)),
        "x_delta_atr_rel": ratio(c("x_delta_atr_3"), rstdp("x_atr_14", 10, 4)), "x_delta_rsi_rel": ratio(c("x_delta_rsi"), rstdp("x_rsi_14", 10, 4)),
        "x_ema_spread_rel": ratio("x_ema_spread", "x_ema_20"), "x_macd_hist_rel": ratio(c("x_macd_hist"), rstdp("x_macd_hist", 15, 5)),
    })
    return d


def x_minmax(df: DataFrame, cols: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """Scale to 0..1 inside the ticker; 0.5 for a constant or empty series."""
    w = Window.partitionBy("ticker")
    out = {}
    for k in cols:
        lo, hi = F.min(k).over(w), F.max(k).over(w)
        out[f"x_{k}_scaled"] = F.when(lo.isNull() | ((hi - lo) <= 1e-8), 0.5).otherwise((c(k) - lo) / (hi - lo))
    return df.withColumns(out)


def x_events(df: DataFrame) -> DataFrame:
    pos, lvi, vz = c("x_pos_in_band"), c("x_local_vol_index"), c("x_volume_z")
    return df.withColumns({
        "x_event_local_vol_spike": flag(lvi > 1.5),
        "x_event_rebound_candidate": flag((pos < 0.35) & (c("x_delta_rsi_3") > 0) & (c("x_delta_macd") > 0) & (vz > 0)),
        "x_event_volume_regain": flag((vz > 0.8) & (c("x_vol_roc") > 0) & (c("x_delta_rsi") > 0)),
        "x_event_exhaustion_candidate": flag((pos > 0.85) & (c("x_delta_ema_spread") < 0) & (c("x_delta_atr_5") > 0) & (vz < 0.5)),
        "x_event_breakdown_risk": flag((lvi > 1.2) & (c("x_macd_hist") < 0) & (c("x_delta_rsi") < 0)),
    })


def x_smoothers(df: DataFrame) -> DataFrame:
    d = ewm(df, {"_xre": ("x_rsi_14", span(5)), "x_atr_smooth": ("x_atr_rel", span(3)), "x_macd_smooth": ("x_macd_hist", span(4)),
                 "x_volume_z_smooth": ("x_volume_z", span(4)), "x_ema_spread_smooth": ("x_ema_spread_rel", span(4))})
    return d.withColumn("x_rsi_smooth", rquantile("_xre", 3, 0.5, 1))


def gauss_kernel(sigma: float, truncate: float = 3.0) -> list[tuple[int, float]]:
    radius = max(1, int(truncate * sigma))
    raw = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-radius, radius + 1)]
    total = sum(v for _, v in raw)
    return [(k, v / total) for k, v in raw]


def gauss_smooth(x: str, sigma: float):
    """Weighted sum of the flags around each bar; outside the series counts as 0."""
    taps = []
    for k, w in gauss_kernel(sigma):
        fn = f"lag(f, {-k}, 0)" if k < 0 else f"lead(f, {k}, 0)"
        taps.append(f"{w!r}D * {fn.replace('f,', x + ',')} OVER ({SERIES})")
    return F.expr(f"least(greatest({' + '.join(taps)}, 0D), 1D)")


def x_gauss_labels(df: DataFrame, sigma: float = 2.0) -> DataFrame:
    return df.withColumns({"x_label_buy_soft": gauss_smooth("x_event_rebound_candidate", sigma),
                           "x_label_sell_soft": gauss_smooth("x_event_breakdown_risk", sigma)})


def explorer_core(df: DataFrame) -> DataFrame:
    """Everything up to the event flags."""
    for step in (x_returns, x_ema_macd, x_wilder, x_bollinger, x_scores, x_events):
        df = step(df)
    return df


def explorer_features(df: DataFrame) -> DataFrame:
    """The full explorer frame with episodes, local scores and soft labels."""
    from .episodes import episode_assign, episode_zscore

    d = episode_assign(explorer_core(x_minmax(df)))
    d = episode_zscore(d, {"x_rsi_local_norm": "x_rsi_14", "x_atr_local_norm": "x_atr_rel", "x_macd_local_norm": "x_macd_hist",
                           "x_ema_spread_local_norm": "x_ema_spread_rel"})
    return drop_temps(x_gauss_labels(x_smoothers(d)))


