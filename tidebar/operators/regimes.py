"""Rule-based market regimes, segments and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import by_ticker, c, change, diff, ffill, lag, ratio, rmean, rquantile, rstd
from .ordered import exact_quantiles, pinned

# State names in id order.
STATES = ["Accumulation", "EarlyUp", "Peak", "Distribution", "LateDown"]


def state_id(name: str):
    x, out = c(name), None
    for i, s in enumerate(STATES):
        out = F.when(x == s, i) if out is None else out.when(x == s, i)
    return out


def _first_match(rules, default):
    """The first rule that holds wins, so rules come in falling priority."""
    out = None
    for state, cond in rules:
        out = F.when(cond, state) if out is None else out.when(cond, state)
    return out.otherwise(default)


def regime_label(df: DataFrame) -> DataFrame:
    """Five states from raw regime features. Peak outranks Accumulation, EarlyUp, LateDown and Distribution in turn."""
    pos, rsi, ret, drsi, spread = (c(k) for k in ("pos_in_band_rel", "rsi_smooth", "price_slope", "delta_rsi", "ema_spread_rel"))
    on = {k: c(k) == 1 for k in ("event_volume_regain", "event_rebound_candidate", "event_exhaustion_candidate",
                                 "event_breakdown_risk", "I_bd_early", "I_bd_late")}
    peak = on["event_exhaustion_candidate"] | on["I_bd_early"] | ((pos > 0.8) & (rsi > 55) & (drsi < 0.5))
    quiet = (pos < 0.4) & (c("atr_rel") < 1.2) & (c("volume_z") < 1.0)
    early = on["event_volume_regain"] | on["event_rebound_candidate"] | ((spread > -0.05) & (ret > -0.01) & (rsi > 40))
    late = (on["I_bd_late"]
            | (on["event_rebound_candidate"] & (c("curv_2") > -0.5) & (spread > -0.5) & (ret < 0.1))
            | ((pos < 0.45) & (rsi < 50) & (drsi < 0)))
    spent = on["event_breakdown_risk"] | ((pos > 0.55) & (ret < 0) & (rsi < 60))
    d = df.withColumn("regime_state", _first_match(
        [("Peak", peak), ("Accumulation", quiet), ("EarlyUp", early), ("LateDown", late), ("Distribution", spent)], "Accumulation"))
    return d.withColumn("regime_state_id", state_id("regime_state"))


def simple_regime_features(df: DataFrame) -> DataFrame:
    d = df.withColumns({"slope": change("close", 3), "_r": change("close"), "_chg": diff("close"),
                        "volume_ratio": ratio(c("volume"), rmean("volume", 20))})
    d = d.withColumns({"curvature": diff("slope"), "volatility": rstd("_r", 10),
                       "_g": F.when(c("_chg") > 0, c("_chg")).otherwise(0.0), "_l": F.when(c("_chg") < 0, -c("_chg")).otherwise(0.0)})
    rs = ratio(rmean("_g", 14), rmean("_l", 14))
    return d.withColumn("rsi", 100 - 100 / (1 + rs)).drop("_r", "_chg", "_g", "_l")


def regime_label_simple(df: DataFrame) -> DataFrame:
    """Five states from slope, curvature, volatility, volume ratio and strength. Needs quantiles over all rows, which
    travel as one row, and rolling 60-row quantiles of the close. Missing features count as 0, as do missing quantiles
    of an unfilled window count as no match."""
    d = pinned(simple_regime_features(df))
    long = d.select(F.explode(F.array(
        F.struct(F.lit("s").alias("_k"), F.col("slope").alias("_v")), F.struct(F.lit("k").alias("_k"), F.col("curvature").alias("_v")),
        F.struct(F.lit("v").alias("_k"), F.coalesce("volatility", F.lit(0.0)).alias("_v")))).alias("_e")).select("_e.*")
    q = exact_quantiles(long, ["_k"], "_v", {"_p15": 0.15, "_p50": 0.5, "_p85": 0.85}, pin=False)
    cuts = q.groupBy().agg(*[F.max(F.when(F.col("_k") == k, F.col(p))).alias(out) for k, p, out in (
        ("s", "_p85", "_s85"), ("s", "_p15", "_s15"), ("k", "_p15", "_k15"), ("v", "_p50", "_vmed"))]).withColumn("_all", F.lit(0))
    d = d.withColumn("_all", F.lit(0)).join(F.broadcast(cuts), "_all")
    d = d.withColumns({
        "event_momentum_burst": F.when(c("slope") > c("_s85"), 1).otherwise(0),
        "event_mean_revert": F.when(c("curvature") < c("_k15"), 1).otherwise(0),
        "event_volume_surge": F.when(c("volume_ratio") > 1.5, 1).otherwise(0),
        "event_breakdown": F.when((c("slope") < c("_s15")) & (c("rsi") < 35), 1).otherwise(0),
        **{f"_q{int(q * 100)}": rquantile("close", 60, q) for q in (0.4, 0.45, 0.6, 0.8)},
    })
    d = d.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("slope", "curvature", "volatility", "volume_ratio", "rsi")})
    close, rsi = c("close"), c("rsi")
    rules = [
        ("Peak", (close > c("_q80")) & (rsi > 60) & (c("curvature") < 0)),
        ("Accumulation", (close < c("_q40")) & (c("volatility") < c("_vmed")) & (c("volume_ratio") < 1.0)),
        ("EarlyUp", (c("event_momentum_burst") == 1) | (c("event_mean_revert") == 1) | ((c("slope") > 0) & (rsi > 40) & (rsi < 60))),
        ("LateDown", (c("event_breakdown") == 1) | ((close < c("_q45")) & (rsi < 50))),
        ("Distribution", (close > c("_q60")) & (c("slope") < 0) & (rsi < 60)),
    ]
    d = d.withColumn("regime", _first_match(rules, "Accumulation"))
    return d.select(*[k for k in d.columns if not k.startswith("_")])


def state_segments(df: DataFrame, state: str) -> DataFrame:
    """Runs of equal state per ticker with first and last date and length."""
    prev = F.lag(state).over(by_ticker())
    d = df.withColumn("_new", F.when(prev.isNull() | (prev != c(state)), 1).otherwise(0))
    d = d.withColumn("segment", F.sum("_new").over(by_ticker(None, 0)))
    return d.groupBy("ticker", "segment").agg(F.first(state).alias("state"), F.min("date").alias("start_date"),
                                              F.max("date").alias("end_date"), F.count("*").alias("bars"))


def regime_transition(df: DataFrame, state: str) -> DataFrame:
    """Counts and probabilities of moving from one state to the next, with the mean stay of the state moved from."""
    df = pinned(df.select("ticker", "date", state))
    d = df.withColumn("_prev", F.lag(state).over(by_ticker()))
    moves = d.where(F.col("_prev").isNotNull()).groupBy(F.col("_prev").alias("from_state"), F.col(state).alias("to_state")).agg(
        F.count("*").alias("moves"))
    moves = moves.withColumn("probability", F.col("moves") / F.sum("moves").over(Window.partitionBy("from_state")))
    stays = state_segments(df, state).groupBy(F.col("state").alias("from_state")).agg(F.avg("bars").alias("mean_stay"))
    return moves.join(stays, "from_state")


def event_onsets(df: DataFrame, event: str) -> DataFrame:
    """Mark the rows where a flag turns on."""
    on = (c(event) == 1) & (F.coalesce(lag(event), F.lit(0)) != 1)
    return df.withColumn("onset", F.when(on, 1).otherwise(0))


def year_segments(df: DataFrame, years: str = "year") -> DataFrame:
    """Runs of contiguous years as text such as 2000-2018."""
    one = Window.partitionBy(F.lit(0)).orderBy(years)
    y = df.select(F.col(years).cast("int").alias(years)).distinct()
    y = y.withColumn("_grp", F.col(years) - F.row_number().over(one))
    seg = y.groupBy("_grp").agg(F.min(years).alias("first_year"), F.max(years).alias("last_year"), F.count("*").alias("years"))
    lo, hi = F.col("first_year").cast("string"), F.col("last_year").cast("string")
    return seg.select("first_year", "last_year", "years", F.when(lo == hi, lo).otherwise(F.concat_ws("-", lo, hi)).alias("slug"))


def hmm_features(df: DataFrame) -> DataFrame:
    """Return, 20-row deviation, strength on -1..1 and change of relative volume, as used for state clustering."""
    d = df.withColumns({"_v": F.when(c("volume") != 0, c("volume").cast("double")), "ret": F.coalesce(change("close"), F.lit(0.0)),
                        "_chg": diff("close")})
    d = d.withColumns({"_v": F.coalesce(ffill("_v"), F.lit(1.0)), "_sd": rstd("ret", 20),
                       "_up": F.when(c("_chg").isNotNull(), F.greatest(c("_chg"), F.lit(0.0))),
                       "_dn": F.when(c("_chg").isNotNull(), F.greatest(-c("_chg"), F.lit(0.0)))})
    whole = F.stddev_samp("ret").over(Window.partitionBy("ticker"))
    rsi = F.coalesce(100 - 100 / (1 + ratio(rmean("_up", 14), rmean("_dn", 14))), F.lit(50.0))
    d = d.withColumns({"vol": F.coalesce(c("_sd"), whole), "rsi_scaled": (rsi - 50) / 50,
                       "_vr": F.coalesce(ratio(c("_v"), rmean("_v", 20)), F.lit(1.0))})
    d = d.withColumn("volume_change", F.coalesce(change("_vr"), F.lit(0.0)))
    return d.drop("_v", "_chg", "_sd", "_up", "_dn", "_vr")


def state_argmax(df: DataFrame, prefix: str = "state_prob_", out: str = "best_state") -> DataFrame:
    """The state with the highest probability; nulls count as -1 and the first column wins a tie."""
    cols = [k for k in df.columns if k.startswith(prefix)]
    if not cols:
        return df.withColumn(out, F.lit("Unknown"))
    vals = {k: F.coalesce(c(k), F.lit(-1.0)) for k in cols}
    best = F.greatest(*vals.values()) if len(cols) > 1 else vals[cols[0]]
    return df.withColumn(out, _first_match([(k[len(prefix):], v == best) for k, v in vals.items()], None))
