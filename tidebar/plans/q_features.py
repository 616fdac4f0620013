"""Queries of the v1, v2, v3 and regime feature blocks, one per operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import SERIES
from ..operators import features as f
from ..operators import regime_block as m
from ..operators.ewm import ewm
from ..operators.ranges import in_ranges
from . import sql_panel as sp
from .registry import panel_query as pq

P = 4  # digits shown for price-scale columns
EXACT = 8  # for prices and their differences, which carry up to seven decimals and must not be cut at a half
DON = {"*": P, "don20_hi": EXACT, "don20_lo": EXACT, "don55_hi": EXACT, "don55_lo": EXACT}

pq("logret_1", f.returns, "t", "logret_1")
pq("ret_5", f.returns, "t", "ret_5")
pq("true_range", f.true_range, "t", "true_range", EXACT)
pq("atr_v1", f.atr_v1, "v1", "atr5 atr10 atr14", P)
pq("vwap_v1", f.vwap_v1, "v1", "vwap10 vwap20", P)
pq("rsi_v1", f.rsi_v1, "v1", "rsi5 rsi10 rsi14", P)

pq("sma_v2", f.sma_v2, "v2a", "sma5 sma10 sma20 sma50", P)
pq("ema_v2", f.ema_v2, "emas", "ema5 ema10 ema20 ema50", P)
sp.step("late0", "bars", late="CASE WHEN row_number() OVER w > 4 AND row_number() OVER w % 7 NOT IN (2, 3, 5) THEN close END")
sp.ewm_step("late1", "late0", slow=("late", 2 / 51), fast=("late", 0.5))


def late_means(d):
    """Exponential means of a series that starts after its first bars and has gaps, in blocks short enough to cross many."""
    row = f"row_number() OVER ({SERIES})"
    d = d.withColumn("late", F.expr(f"CASE WHEN {row} > 4 AND {row} % 7 NOT IN (2, 3, 5) THEN close END"))
    return ewm(d, {"slow": ("late", 2 / 51), "fast": ("late", 0.5)}, block=64)


pq("ewm_native", late_means, "late1", "slow fast", P)
# The same operators with every series cut into ranges of 100 rows that read the rows before them.
for key, fn, halo, src, cols in (("atr_v1", f.atr_v1, 15, "v1", "atr5 atr10 atr14"), ("stoch_v2", f.stoch_v2, 16, "v2c", "stochk5 stochk14 stochd14 stoch_spread"),
                                 ("cci20", f.cci20, 39, "v2c", "cci20")):
    pq(f"{key}_ranges", lambda d, fn=fn, halo=halo: in_ranges(d, fn, halo, rows=100), src, cols, P)

pq("roc_v2", f.roc_v2, "v2a", "roc5 roc10 roc20")
pq("rsi6", f.rsi6, "v2a", "rsi6", P)
pq("stoch_v2", f.stoch_v2, "v2c", "stochk5 stochk14 stochd14 stoch_spread", P)
pq("willr14", f.willr14, "v2a", "willr14", P)
pq("cci20", f.cci20, "v2c", "cci20", P)
pq("macd_v2", f.macd_v2, "macds", "macd macd_signal macd_hist", P)
pq("vol_v2", f.volatility_v2, "v2a", "vol10 vol20")
pq("parkinson20", f.volatility_v2, "v2a", "parkinson20")
pq("gk20", f.volatility_v2, "v2a", "gk20")
pq("tr14", f.volatility_v2, "v2a", "tr14", P)
pq("obv", f.obv, "v2a", "obv", P)
pq("mfi14", f.mfi14, "v2b", "mfi14", P)
pq("cmf20", f.cmf20, "v2b", "cmf20")
pq("vwap_v2", f.vwap_v2, "v2a", "vwap10 vwap20", P)
pq("vol_z20", f.volume_v2, "v2a", "vol_z20 vol_roc5")
pq("donchian_v2", f.donchian_v2, "v2a", "don20_hi don20_lo don55_hi don55_lo pos_in_don20", DON)
pq("rel_range", f.rel_range, "v2a", "rel_range")
pq("corr_close_vol20", f.co_moves_v2, "v2c", "corr_close_vol20 corr_obv_vwap20")
pq("curv5", f.curv5, "v2b", "curv5", P)
pq("dev_sma20", lambda d: f.spreads_v2(f.sma_v2(f.ema_v2(d, f.MACD_EMAS))), "v2f",
   "dev_sma20 dev_ema20 ma_squeeze_20_50 ema12_26_rel")
pq("v2_fill", lambda d: f.v2_features(f.core_features(d)), "filled", sp.V2_COLS + " vwap10 vwap20 rsi14 atr14", DON)

pq("dm_v3", f.dm_v3, "v2b", "plus_dm minus_dm", EXACT)
pq("di_v3", f.di_v3, "v2c", "plus_di14 minus_di14", 3)
pq("adx14", f.adx14, "v3a", "adx14", P)
pq("v_pattern", f.v_pattern, "v2c", "v_pattern")
pq("v2_pattern", f.v2_pattern, "v2c", "v2_pattern", 3)
pq("rsi5_v3", f.rsi5_v3, "v1", "rsi5", P)
pq("aroon_v3", f.aroon_v3, "v2b", "aroon_up20 aroon_dn20", P)
pq("psar_proxy", f.ema_atr_v3, "v3e", "psar_proxy kama10", P)
pq("v3_fill", lambda d: f.add_feature_set(d, "v3"), "filled", sp.V3_COLS, 3)


pq("ema_atr_v3", lambda d: f.ema_atr_v3(d).withColumnRenamed("atr5", "atr5_plain"), "v3f", "ema5 ema14 atr5_plain", P)

pq("ret1", m.derivatives, "m1", "ret1 vol_roc1 delta_rsi delta_rsi_3 ema_spread delta_macd delta_atr", P)
pq("local_vol_index", m.local_vol_index, "m2", "local_vol_index")
pq("bollinger", m.bollinger, "m3b", "bb_mid bb_std bb_upper bb_lower bb_band_width pos_in_band_rel bb_width", P)
pq("ema_spread_rel", m.spread_slopes, "m3b", "ema_spread_rel delta_ema_spread ema_spread_rel_slope", P)
pq("atr_rel", m.atr_relatives, "m3b", "atr_rel delta_atr_rel atr_slope")
pq("volume_z", m.slopes, "m3b", "volume_z price_accel price_slope macd_signal_slope", P)
pq("close_norm", m.bollinger, "m3b", "close_norm")
pq("curv_2", m.curv_2, "m3b", "curv_2")
pq("smoothers", m.smoothers, "m002", "rsi_smooth macd_smooth atr_smooth volume_z_smooth ema_spread_smooth", P)
pq("ev_local_vol_spike", m.events, "m002", "", ints="event_local_vol_spike")
pq("ev_rebound_candidate", m.events, "m002", "", ints="event_rebound_candidate")
pq("ev_volume_regain", m.events, "m002", "", ints="event_volume_regain")
pq("ev_exhaustion_candidate", m.events, "m002", "", ints="event_exhaustion_candidate")
pq("ev_breakdown_risk", m.events, "m002", "", ints="event_breakdown_risk")
pq("I_vr_and_vs", m.interactions, "m002", "", ints="I_vr_and_vs I_bd_early I_bd_late")
pq("event_freq20", m.event_freq20, "m002", "event_volume_regain_freq20 event_breakdown_freq20 event_local_vol_freq20")
pq("recent_extremes", m.recent_extremes, "m3b", "recent_high_60 recent_low_60 recovery_from_low_60 distance_from_high_60", {"*": P, "recent_high_60": EXACT, "recent_low_60": EXACT})
pq("days_since_event", m.days_since_event, "m002", "", ints="days_since_volume_regain days_since_breakdown")
M002_SHOWN = "rsi_smooth macd_smooth atr_smooth curv_2 local_vol_index pos_in_band_rel ema_spread_rel recovery_from_low_60"
pq("feature_set", lambda d: f.add_feature_set(d, "m002"), "m002", M002_SHOWN, P,
   ints="event_breakdown_risk I_bd_late days_since_breakdown")
