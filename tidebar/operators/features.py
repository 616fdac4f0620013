"""Technical features of a bar panel, in three blocks named v1, v2 and v3.

Each function takes and returns a panel. Working columns start with an underscore, are shared between the functions
and go away with ``drop_temps``. Features not asked for cost nothing: the optimizer prunes their window expressions.

A window pass copies every row once per frame, so wide panels want few passes. A group of features is written as layers
of columns, each reading the ones before it; a block merges the layers of all its groups, and each merged layer is one
window pass over the series.

Three names are kept although the value is not the textbook one, because results must match: the rolling correlations
use each row's own rolling mean, the directional index divides a sum by a mean, and aroon, psar and kama are proxies.
"""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import (
    SERIES, c, change, diff, drop_temps, ffill, lag, ratio, rmax, rmean, rmin, rstd, rsum, sdiv,
)
from .ewm import ewm, span

PRICES = ["open", "high", "low", "close", "adj_close"]
BASE = ["date", "ticker", "market", "exchange", "currency", "year", "volume", "turnover", *PRICES]


def terms(df: DataFrame) -> DataFrame:
    """Shared per-bar terms: previous close, typical price, true range, gains and losses."""
    if "_tr" in df.columns:
        return df
    pc = F.col("_pc")
    return (
        df.withColumns({"_pc": lag("close"), "_tp": (c("high") + c("low") + c("close")) / 3})
        .withColumns({
            "_tr": F.greatest(c("high") - c("low"), F.abs(c("high") - pc), F.abs(c("low") - pc)),
            "_chg": c("close") - pc,
            "_gain": F.when(c("close") > pc, c("close") - pc).otherwise(0.0),
            "_loss": F.when(c("close") < pc, pc - c("close")).otherwise(0.0),
            "_pv": c("_tp") * c("volume"),
        })
    )


def in_layers(df: DataFrame, groups) -> DataFrame:
    """Apply groups of layered columns together: first layers first, in one pass, then second layers, and so on."""
    d = terms(df)
    for layer in zip_longest(*[g.layers() for g in groups], fillvalue={}):
        merged = {}
        for cols in layer:
            merged.update(cols)
        d = d.withColumns(merged)
    return d


def group(layers):
    """A panel operator from a function that lists its layers of columns."""

    def run(df: DataFrame) -> DataFrame:
        return in_layers(df, [run])

    run.layers, run.__name__, run.__doc__ = layers, layers.__name__, layers.__doc__
    return run


# ---- v1 ----

@group
def returns():
    return [{"logret_1": F.ln("close") - lag("ln(close)"), "ret_5": change("close", 5)}]


@group
def true_range():
    return [{"true_range": c("_tr")}]


@group
def atr_v1():
    """Mean true range over 5, 10 and 14 rows; while a window fills, the next shorter one stands in."""
    m5, m10, m14 = (rmean("_tr", n) for n in (5, 10, 14))
    return [{"atr5": F.coalesce(m5, c("_tr")), "atr10": F.coalesce(m10, m5), "atr14": F.coalesce(m14, m10)}]


@group
def vwap_v1():
    v = "coalesce(volume, 0D)"
    v10, v20 = (sdiv(rsum(f"(_tp * {v})", n), rsum(v, n)) for n in (10, 20))
    return [{"vwap10": v10, "vwap20": F.coalesce(v20, v10)}]


def _strength(gain, loss):
    return 100 - ratio(F.lit(100.0), 1 + sdiv(gain, loss))


def _short_strength(n: int):
    return _strength(F.coalesce(rmean("_gain", n), c("_gain")), F.coalesce(rmean("_loss", n), c("_loss")))


@group
def rsi_v1():
    """Relative strength from plain rolling means, each window falling back one step while it fills."""
    g = {n: rmean("_gain", n) for n in (5, 10, 14)}
    s = {n: rmean("_loss", n) for n in (5, 10, 14)}
    return [{
        "rsi5": _short_strength(5),
        "rsi10": _strength(F.coalesce(g[10], g[5], c("_gain")), F.coalesce(s[10], s[5], c("_loss"))),
        "rsi14": _strength(F.coalesce(g[14], g[10]), F.coalesce(s[14], s[10])),
    }]


V1_GROUPS = (returns, atr_v1, vwap_v1, rsi_v1)


def core_features(df: DataFrame) -> DataFrame:
    return in_layers(df, V1_GROUPS)


# ---- v2 ----

@group
def sma_v2():
    return [{f"sma{n}": rmean("close", n) for n in (5, 10, 20, 50)}]


def ema_v2(df: DataFrame, extra: dict | None = None) -> DataFrame:
    return ewm(df, {**{f"ema{n}": ("close", span(n)) for n in (5, 10, 20, 50)}, **(extra or {})})


@group
def roc_v2():
    return [{f"roc{n}": change("close", n) for n in (5, 10, 20)}]


@group
def rsi6():
    return [{"rsi6": _short_strength(6)}]


def _channel():
    return {f"_{t}{n}": f(x, n) for n in (5, 14) for t, f, x in (("hi", rmax, "high"), ("lo", rmin, "low"))}


@group
def stoch_v2():
    k = {n: 100 * sdiv(f"close - _lo{n}", f"_hi{n} - _lo{n}") for n in (5, 14)}
    d = F.coalesce(rmean("stochk14", 3), c("stochk14"))
    return [_channel(), {"stochk5": k[5], "stochk14": F.coalesce(k[14], k[5])}, {"stochd14": d, "stoch_spread": c("stochk14") - d}]


@group
def willr14():
    r = {n: -100 * sdiv(f"_hi{n} - close", f"_hi{n} - _lo{n}") for n in (5, 14)}
    return [_channel(), {"willr14": F.coalesce(r[14], r[5])}]


@group
def cci20():
    """Commodity channel index; every deviation is taken against the mean of its own day."""
    v = {n: sdiv(c("_tp") - c(f"_tpm{n}"), 0.015 * rmean(f"abs(_tp - _tpm{n})", n)) for n in (10, 20)}
    return [{f"_tpm{n}": rmean("_tp", n) for n in (10, 20)}, {"cci20": F.coalesce(v[20], v[10])}]


MACD_EMAS = {"_ema12": ("close", span(12)), "_ema26": ("close", span(26))}


def macd_v2(df: DataFrame) -> DataFrame:
    d = df if "_ema12" in df.columns else ewm(df, MACD_EMAS)
    d = d.withColumn("macd", c("_ema12") - c("_ema26"))
    return ewm(d, {"macd_signal": ("macd", span(9))}).withColumn("macd_hist", c("macd") - c("macd_signal"))


@group
def volatility_v2():
    """Deviation of log returns, two range-based estimators and the mean true range."""
    ln2 = "0.6931471805599453D"
    hl, co = "power(ln(try_divide(high, low)), 2)", "power(ln(try_divide(close, open)), 2)"
    return [{"_lr": F.ln("close") - lag("ln(close)"), "parkinson20": rmean(f"({hl} / (4D * {ln2}))", 20),
             "gk20": rmean(f"(0.5D * {hl} - (2D * {ln2} - 1D) * {co})", 20), "tr14": rmean("_tr", 14)},
            {"vol10": rstd("_lr", 10), "vol20": rstd("_lr", 20)}]


def _obv():
    return F.expr("sum(CASE WHEN close > _pc THEN volume WHEN close < _pc THEN -volume ELSE 0D END) "
                  f"OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@group
def obv():
    return [{"obv": _obv()}]


@group
def mfi14():
    up, down = (rsum(f"(CASE WHEN _tp {op} _tp1 THEN _pv ELSE 0D END)", 14) for op in "><")
    return [{"_tp1": lag("_tp")}, {"mfi14": _strength(up, down)}]


MONEY_FLOW = "(try_divide((close - low) - (high - close), high - low + 1e-9D) * volume)"


@group
def cmf20():
    return [{"cmf20": sdiv(rsum(MONEY_FLOW, 20), rsum("volume", 20))}]


@group
def vwap_v2():
    return [{f"vwap{n}": sdiv(rsum("_pv", n), rsum("volume", n)) for n in (10, 20)}]


@group
def volume_v2():
    return [{"vol_z20": sdiv(c("volume") - rmean("volume", 20), rstd("volume", 20)), "vol_roc5": sdiv(c("volume"), lag("volume", 5)) - 1}]


@group
def donchian_v2():
    d = {f"don{n}_{t}": f(x, n) for n in (20, 55) for t, f, x in (("hi", rmax, "high"), ("lo", rmin, "low"))}
    return [d, {"pos_in_don20": sdiv("close - don20_lo", "don20_hi - don20_lo")}]


@group
def rel_range():
    return [{"rel_range": sdiv("high - low", "close")}]


@group
def co_moves_v2():
    """Close against volume and obv against vwap20: mean product of own-day deviations over the rolling deviations."""

    def own(*names):
        return {**{f"_dev_{x}": c(x) - rmean(x, 20) for x in names}, **{f"_std_{x}": rstd(x, 20) for x in names}}

    def pair(x, y):
        return sdiv(rmean(f"(_dev_{x} * _dev_{y})", 20), c(f"_std_{x}") * c(f"_std_{y}"))

    return [{**own("close", "volume"), "obv": _obv(), "vwap20": vwap_v2.layers()[0]["vwap20"]},
            {**own("obv", "vwap20"), "corr_close_vol20": pair("close", "volume")}, {"corr_obv_vwap20": pair("obv", "vwap20")}]


@group
def curv5():
    return [{"_chg1": lag("_chg")}, {"curv5": rmean("(_chg - _chg1)", 5)}]


def spreads_v2(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "dev_sma20": sdiv("close - sma20", "sma20"),
        "dev_ema20": sdiv("close - ema20", "ema20"),
        "ma_squeeze_20_50": sdiv("sma20 - sma50", "sma50"),
        "ema12_26_rel": sdiv("_ema12 - _ema26", "close"),
    })


def fill_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Carry feature values forward inside each ticker and put 0 before the first one. Prices are left alone."""
    if cols is None:
        cols = [f.name for f in df.schema.fields
                if f.dataType.typeName() == "double" and f.name not in BASE and not f.name.startswith("_")]
    return df.withColumns({k: F.coalesce(ffill(k), F.lit(0.0)) for k in cols})


V2_GROUPS = (sma_v2, roc_v2, rsi6, stoch_v2, willr14, cci20, volatility_v2, obv, mfi14, cmf20, vwap_v2, volume_v2, donchian_v2, rel_range,
             co_moves_v2, curv5)


def v2_features(df: DataFrame, extra: dict | None = None) -> DataFrame:
    """All v2 features on top of v1, filled. The exponential means come first, while rows are narrow; ``extra`` ones of later
    blocks are taken in the same passes."""
    return drop_temps(fill_features(spreads_v2(in_layers(macd_v2(ema_v2(df, MACD_EMAS | (extra or {}))), V2_GROUPS))))


# ---- v3 ----

@group
def dm_v3():
    up, down = diff("high"), lag("low") - c("low")
    u, w = c("_hmove"), c("_lmove")
    return [{"_hmove": up, "_lmove": down}, {"plus_dm": F.when((u > w) & (u > 0), u).otherwise(0.0), "minus_dm": F.when((w > u) & (w > 0), w).otherwise(0.0)}]


@group
def di_v3():
    def di(x, n):
        return 100 * sdiv(rsum(x, n), rmean("_tr", n))

    return [*dm_v3.layers(), {f"{s}_di14": F.coalesce(di(f"{s}_dm", 14), di(f"{s}_dm", 5)) for s in ("plus", "minus")}]


@group
def adx14():
    dx = "(100 * try_divide(abs(plus_di14 - minus_di14), plus_di14 + minus_di14 + 1e-9D))"
    return [*di_v3.layers(), {"adx14": F.coalesce(rmean(dx, 14), rmean(dx, 5))}]


@group
def v_pattern():
    v = {n: sdiv(rsum(f"({MONEY_FLOW} / (1D + 1e-9D))", n), rsum("volume", n)) for n in (10, 20)}
    return [{"v_pattern": F.coalesce(v[20], v[10])}]


@group
def v2_pattern():
    v = {n: sdiv(rsum("_pv", n), rsum("volume", n)) for n in (10, 20)}
    return [{"_obv": _obv(), "_vw": F.coalesce(v[20], v[10])}, {"v2_pattern": diff("_obv", 5) * (c("close") - c("_vw"))}]


@group
def rsi5_v3():
    return [{"rsi5": _short_strength(5)}]


@group
def means_v3():
    return [{"atr5": rmean("_tr", 5), "psar_proxy": rmean("close", 5)}]


V3_EMAS = {"ema5": ("close", span(5)), "ema14": ("close", span(14)), "kama10": ("close", 0.2)}


def ema_atr_v3(df: DataFrame) -> DataFrame:
    return means_v3(ewm(df, V3_EMAS))


def aroon_v3(df: DataFrame) -> DataFrame:
    d = df if "pos_in_don20" in df.columns else donchian_v2(df)
    return d.withColumns({"aroon_up20": c("pos_in_don20") * 100, "aroon_dn20": (1 - c("pos_in_don20")) * 100})


V3_GROUPS = (adx14, v_pattern, v2_pattern, rsi5_v3, means_v3)


def v3_features(df: DataFrame) -> DataFrame:
    """All v3 features on top of v2, filled. The directional movements themselves are working columns."""
    d = df if set(V3_EMAS) <= set(df.columns) else ewm(df, V3_EMAS)
    return drop_temps(fill_features(aroon_v3(in_layers(d, V3_GROUPS)).drop("plus_dm", "minus_dm")))


def add_feature_set(df: DataFrame, feature_set: str = "v1") -> DataFrame:
    """v1, v2 (v1 and v2), v3 (all three) or m002 (all three and the regime block)."""
    from .regime_block import m002_features

    v2_and_more = lambda d: v2_features(d, V3_EMAS)
    chains = {"v1": (core_features,), "v2": (core_features, v2_features), "v3": (core_features, v2_and_more, v3_features),
              "m002": (core_features, v2_and_more, v3_features, m002_features)}
    if feature_set not in chains:
        raise ValueError(f"unknown feature_set: {feature_set}")
    for step in chains[feature_set]:
        df = step(df)
    return drop_temps(df)
