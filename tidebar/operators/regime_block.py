"""Features, event flags and context counts used by the regime rules and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import (
    by_ticker, c, change, clip, diff, drop_temps, flag, rmax, rmean, rmin, rquantile, rstd, rsum, sdiv,
)
from .ewm import ewm, span
from .features import atr_v1, fill_features, macd_v2, rsi_v1, terms, volume_v2

EVENTS = ["event_local_vol_spike", "event_rebound_candidate", "event_volume_regain", "event_exhaustion_candidate",
          "event_breakdown_risk"]
INPUTS = ["rsi14", "atr14", "macd_hist", "macd_signal", "ema5", "ema20", "vol_z20"]


def inputs(df: DataFrame) -> DataFrame:
    """The earlier features this block reads. Computes only these when the earlier blocks have not been added."""
    if set(INPUTS) <= set(df.columns):
        return df
    d = volume_v2(rsi_v1(atr_v1(terms(df))))
    d = ewm(d, {"ema5": ("close", span(5)), "ema20": ("close", span(20)), "_ema12": ("close", span(12)),
                "_ema26": ("close", span(26))})
    return fill_features(macd_v2(d), INPUTS)


def derivatives(df: DataFrame) -> DataFrame:
    d = inputs(df)
    return d.withColumns({
        "ret1": change("close"), "vol_roc1": change("volume"), "delta_rsi": diff("rsi14"), "delta_rsi_3": diff("rsi14", 3),
        "delta_macd": diff("macd_hist"), "ema_spread": c("ema5") - c("ema20"), "delta_atr": diff("atr14"),
    })


def local_vol_index(df: DataFrame) -> DataFrame:
    d = df if "ret1" in df.columns else derivatives(df)
    return d.withColumn("local_vol_index", sdiv(rstd("ret1", 5), rstd("ret1", 20)))


def bollinger(df: DataFrame) -> DataFrame:
    mid, std = c("bb_mid"), c("bb_std")
    d = df.withColumns({"bb_mid": rmean("close", 20), "bb_std": rstd("close", 20)})
    d = d.withColumns({"bb_upper": mid + 2 * std, "bb_lower": mid - 2 * std,
                       "bb_band_width": (mid + 2 * std) - (mid - 2 * std)})
    return d.withColumns({"pos_in_band_rel": clip(sdiv("close - bb_mid", "bb_band_width"), 0.0, 1.0),
                          "bb_width": sdiv("bb_band_width", "abs(bb_mid)"), "close_norm": sdiv("close - bb_mid", "bb_std")})


def spread_slopes(df: DataFrame) -> DataFrame:
    d = df if "ema_spread" in df.columns else derivatives(df)
    d = d.withColumns({"ema_spread_rel": sdiv("ema_spread", "ema20"), "delta_ema_spread": diff("ema_spread")})
    return d.withColumn("ema_spread_rel_slope", diff("ema_spread_rel"))


def atr_relatives(df: DataFrame) -> DataFrame:
    d = df if "delta_atr" in df.columns else derivatives(df)
    d = d.withColumns({"atr_rel": sdiv("atr14", rmean("atr14", 20)), "delta_atr_rel": sdiv("delta_atr", rstd("atr14", 10))})
    return d.withColumn("atr_slope", diff("atr_rel"))


def slopes(df: DataFrame) -> DataFrame:
    d = df if "ret1" in df.columns else derivatives(df)
    return d.withColumns({"volume_z": c("vol_z20"), "price_accel": diff("ret1"), "price_slope": c("ret1"),
                          "macd_signal_slope": diff("macd_signal")})


def curvature_weights(k: int) -> list[float]:
    """Second derivative at the middle point of a cubic fitted to k evenly spaced values, as weights on the values."""
    import numpy as np

    x = np.arange(k, dtype=float)
    rows = np.linalg.pinv(np.vander(x, 4))
    return [float(v) for v in 6 * x[k // 2] * rows[0] + 2 * rows[1]]


def curv_2(df: DataFrame, x: str = "close_norm", n: int = 11, need: int = 5, out: str = "curv_2") -> DataFrame:
    """Curvature of the values present in the last ``n`` rows. A least-squares fit is linear in the values, so each
    window is a dot product with fixed weights chosen by how many values it holds."""
    d = df if x in df.columns else bollinger(df)
    d = d.withColumn("_win", F.collect_list(x).over(by_ticker(-(n - 1), 0)))
    value: Column | None = None
    for k in range(need, n + 1):
        w = curvature_weights(k)
        dot = sum((F.get("_win", F.lit(i)) * w[i] for i in range(1, k)), F.get("_win", F.lit(0)) * w[0])
        value = F.when(F.size("_win") == k, dot) if value is None else value.when(F.size("_win") == k, dot)
    return d.withColumn(out, value).drop("_win")


def smoothers(df: DataFrame) -> DataFrame:
    d = df if "atr_rel" in df.columns else slopes(atr_relatives(spread_slopes(df)))
    d = ewm(d, {"_rsi_e": ("rsi14", span(5)), "_macd_e": ("macd_hist", span(4)), "_atr_e": ("atr_rel", span(3)),
                "_vz_e": ("volume_z", span(4)), "_sp_e": ("ema_spread_rel", span(4))})
    return d.withColumns({
        "rsi_smooth": F.coalesce(rquantile("_rsi_e", 3, 0.5), c("_rsi_e")), "macd_smooth": rmean("_macd_e", 3),
        "atr_smooth": rmean("_atr_e", 3), "volume_z_smooth": rmean("_vz_e", 3), "ema_spread_smooth": rmean("_sp_e", 3),
    })


def events(df: DataFrame) -> DataFrame:
    d = df if "volume_z" in df.columns else slopes(atr_relatives(spread_slopes(bollinger(local_vol_index(df)))))
    pos, lvi, vz = c("pos_in_band_rel"), c("local_vol_index"), c("volume_z")
    return d.withColumns({
        "event_local_vol_spike": flag(lvi > 1.5),
        "event_rebound_candidate": flag((pos < 0.35) & (c("delta_rsi_3") > 0) & (c("delta_macd") > 0) & (vz > 0)),
        "event_volume_regain": flag((vz > 0.8) & (c("vol_roc1") > 0) & (c("delta_rsi") > 0)),
        "event_exhaustion_candidate": flag((pos > 0.85) & (c("delta_ema_spread") < 0) & (c("delta_atr") > 0) & (vz < 0.5)),
        "event_breakdown_risk": flag((lvi > 1.2) & (c("macd_hist") < 0) & (c("delta_rsi") < 0)),
    })


def interactions(df: DataFrame) -> DataFrame:
    d = df if EVENTS[0] in df.columns else events(df)
    d = d if "curv_2" in d.columns else curv_2(d)
    bd = c("event_breakdown_risk") == 1
    return d.withColumns({
        "I_vr_and_vs": flag((c("event_volume_regain") == 1) & (c("event_local_vol_spike") == 1)),
        "I_bd_early": flag(bd & (c("curv_2") < 0) & (c("ema_spread_rel") < 0) & (c("delta_rsi") < 0)),
        "I_bd_late": flag(bd & (c("curv_2") > 0) & (c("rsi14") < 40) & (c("macd_signal_slope") > 0)),
    })


def event_freq20(df: DataFrame) -> DataFrame:
    d = df if EVENTS[0] in df.columns else events(df)
    return d.withColumns({"event_volume_regain_freq20": rsum("event_volume_regain", 20),
                          "event_breakdown_freq20": rsum("event_breakdown_risk", 20),
                          "event_local_vol_freq20": rsum("event_local_vol_spike", 20)})


def recent_extremes(df: DataFrame) -> DataFrame:
    d = df.withColumns({"recent_high_60": rmax("close", 60), "recent_low_60": rmin("close", 60)})
    return d.withColumns({"recovery_from_low_60": sdiv("close - recent_low_60", "recent_low_60"),
                          "distance_from_high_60": sdiv("close - recent_high_60", "recent_high_60")})


def days_since_event(df: DataFrame) -> DataFrame:
    d = df if EVENTS[0] in df.columns else events(df)

    def since(e):
        last = F.last(F.when(c(e) > 0, c("date")), ignorenulls=True).over(by_ticker(None, 0))
        return F.coalesce(F.datediff("date", last), F.lit(1000))

    return d.withColumns({"days_since_volume_regain": since("event_volume_regain"),
                          "days_since_breakdown": since("event_breakdown_risk")})


def m002_features(df: DataFrame) -> DataFrame:
    for step in (derivatives, local_vol_index, bollinger, spread_slopes, atr_relatives, slopes, curv_2, events,
                 interactions, event_freq20, recent_extremes, days_since_event, smoothers):
        df = step(df)
    return drop_temps(df)
