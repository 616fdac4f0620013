"""Queries for policy, signals, trades, metrics and feature analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import c
from ..operators import analytics as an
from ..operators import labels as lab
from ..operators import metrics as mt
from ..operators import policy as po
from ..operators import trades as tr
from ..operators.features import atr_v1, returns, rsi_v1
from . import inputs as inp
from .inputs import bars
from .registry import cte, query, shown, sr, with_
from .sql_panel import R, L, Q, Z, step

KEYS = "ticker, strftime(date, '%Y-%m-%d') AS date"
NAMES = {"prob": "pred_rebound_prob", "exp_ret": "pred_expected_ret_pct", "exp_dd": "pred_expected_dd_pct", "peak": "state_prob_Peak"}


def policy_input(spark, sf):
    d = inp.regime_scores(spark, sf).withColumnsRenamed(NAMES)
    return po.policy_score(d.select("ticker", "date", "close", "atr_smooth", "I_vr_and_vs", "I_bd_early", "I_bd_late", *NAMES.values()))


step("pol0", "scm", policy_score="prob * (exp_ret / 100) - 0.5 * greatest(0.0, -(exp_dd / 100))")
AV = R("avg", "atr_smooth", 5, 1)
step("pol1", "pol0", ex_ante_vol=f"greatest(coalesce(abs({AV}), 0.15), 0.15::DOUBLE)", score_z=f"coalesce({Z('policy_score', 60, 20)}, 0)")
cte("pol2", "pol1", "SELECT *, score_z * 3.0::DOUBLE AS effective_score FROM pol1")
cte("polq", "pol2", "SELECT quantile_cont(effective_score, 0.45) AS long_q, quantile_cont(effective_score, 0.30) AS short_q, quantile_cont(effective_score, 0.425) AS flat_low, quantile_cont(effective_score, 0.575) AS flat_high FROM pol2")
ADJ = "* CASE WHEN I_vr_and_vs = 1 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN I_bd_late = 1 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN I_bd_early = 1 THEN 1.1::DOUBLE ELSE 1 END"
cte("pol3", "pol2 polq", f"""SELECT *, CASE WHEN abs(s) < 0.1 OR exp_ret < 0.1 THEN 'FLAT' WHEN s >= long_q THEN CASE WHEN peak <= 0.7 THEN 'LONG' ELSE 'FLAT' END
  WHEN s <= short_q OR (peak >= 0.35 AND s < flat_low) THEN 'SHORT' ELSE 'FLAT' END AS action FROM (SELECT *, effective_score {ADJ} AS s FROM pol2, polq)""")
cte("pol", "pol3", "SELECT *, CASE WHEN action = 'FLAT' THEN 0 ELSE least(greatest(1.2::DOUBLE * effective_score / ex_ante_vol, -1), 1) END AS position_size FROM pol3")


def pol_sql(cols: str, nd: int = 6, text: str = "", src: str = "pol") -> str:
    return with_(src, f"SELECT {KEYS}, " + ", ".join([f"{sr(k, nd)} AS {k}" for k in cols.split()] + text.split()) + f" FROM {src}")


@query("policy_score", pol_sql("policy_score", src="pol0"))
def _(spark, sf):
    d = inp.scores(spark, sf).withColumnsRenamed(NAMES)
    return shown(po.policy_score(d).select("ticker", "date", "policy_score"))


@query("ex_ante_vol", pol_sql("ex_ante_vol", src="pol1"))
def _(spark, sf):
    return shown(po.ex_ante_vol(policy_input(spark, sf)).select("ticker", "date", "ex_ante_vol"))


@query("score_rescale", pol_sql("effective_score", src="pol2"))
def _(spark, sf):
    return shown(po.score_rescale(policy_input(spark, sf)).select("ticker", "date", "effective_score"))


@query("policy_quantiles", with_("polq", "SELECT " + ", ".join(f"{sr(k)} AS {k}" for k in ("long_q", "short_q", "flat_low", "flat_high")) + " FROM polq"))
def _(spark, sf):
    return shown(po.policy_quantiles(po.score_rescale(policy_input(spark, sf))))


@query("policy_action", pol_sql("", text="action"))
def _(spark, sf):
    return shown(po.apply_policy(policy_input(spark, sf)).select("ticker", "date", "action"))


@query("position_size", pol_sql("position_size"))
def _(spark, sf):
    return shown(po.apply_policy(policy_input(spark, sf)).select("ticker", "date", "position_size"))


GRID_A = """CASE WHEN abs(s) < 0.1 OR exp_ret < 0.1 THEN 'FLAT' WHEN s >= lq THEN CASE WHEN peak <= 0.7 THEN 'LONG' ELSE 'FLAT' END WHEN s <= sq OR (peak >= 0.35 AND s < fl) THEN 'SHORT' ELSE 'FLAT' END"""


@query("policy_grid", with_("pol1", f"""SELECT score_scale, size_k, {sr('long_ratio')} AS long_ratio, {sr('short_ratio')} AS short_ratio, {sr('flat_ratio')} AS flat_ratio, {sr('long_size_mean')} AS long_size_mean, {sr('score')} AS score,
  CAST(CASE WHEN row_number() OVER (ORDER BY score DESC, score_scale, size_k) = 1 THEN 1 ELSE 0 END AS BIGINT) AS best FROM
  (SELECT *, policy_mean - power(long_ratio - 0.55, 2) - power(short_ratio - 0.3, 2) - power(flat_ratio - 0.15, 2) - power(greatest(0.15 - long_size_mean, 0), 2) AS score FROM
  (SELECT score_scale, size_k, avg(CASE WHEN action = 'LONG' THEN 1.0 ELSE 0 END) AS long_ratio, avg(CASE WHEN action = 'SHORT' THEN 1.0 ELSE 0 END) AS short_ratio, avg(CASE WHEN action = 'FLAT' THEN 1.0 ELSE 0 END) AS flat_ratio,
   coalesce(avg(least(abs(size_k * eff / ex_ante_vol), 1)) FILTER (action = 'LONG'), 0) AS long_size_mean, avg(policy_score) AS policy_mean FROM
  (SELECT *, {GRID_A} AS action FROM (SELECT *, eff {ADJ} AS s FROM (SELECT *, score_z * score_scale AS eff, quantile_cont(score_z, 0.45) OVER () * score_scale AS lq, quantile_cont(score_z, 0.30) OVER () * score_scale AS sq,
   quantile_cont(score_z, 0.425) OVER () * score_scale AS fl FROM pol1, (SELECT unnest([0.5, 0.8, 1.0, 1.5, 2.0, 2.5, 3.0]::DOUBLE[]) AS score_scale)))), (SELECT unnest([0.5, 0.8, 1.0, 1.2, 1.5]::DOUBLE[]) AS size_k) GROUP BY ALL))"""))
def _(spark, sf):
    return shown(po.policy_grid(policy_input(spark, sf)).drop("policy_mean"))


step("ab0", "bars", ret_1d=f"close / {L('close')} - 1", slope_3d=f"close / {L('close', 3)} - 1", volume_ratio=Q("volume", R("avg", "volume", 20)), ret_5d_ahead="lead(close, 5) OVER w / close - 1")
step("ab1", "ab0", curvature=f"slope_3d - {L('slope_3d')}", volatility_10d=R("stddev_samp", "ret_1d", 10))
cte("ab2", "ab1", "SELECT *, 2.1 * slope_3d - 1.3 * curvature - 0.4 * volatility_10d + 0.6 * (volume_ratio - median(volume_ratio) OVER (PARTITION BY ticker)) AS x FROM ab1 "
    "WHERE curvature IS NOT NULL AND volatility_10d IS NOT NULL AND volume_ratio IS NOT NULL AND ret_5d_ahead IS NOT NULL")


@query("action_by_prob", with_("ab2", f"""SELECT {KEYS}, {sr('p')} AS prob_rebound, action, CAST(CASE WHEN CASE action WHEN 'Long' THEN 1 WHEN 'Short' THEN -1 ELSE 0 END = sign(ret_5d_ahead) THEN 1 ELSE 0 END AS BIGINT) AS hit FROM
  (SELECT *, CASE WHEN p >= 0.62 THEN 'Long' WHEN p <= 0.4 THEN 'Short' ELSE 'Flat' END AS action FROM (SELECT *, 1 / (1 + exp(-4.5 * x)) AS p FROM ab2))"""))
def _(spark, sf):
    return shown(po.action_by_prob(bars(spark, sf)).select("ticker", "date", "prob_rebound", "action", "hit"))


def two_signals(spark, sf):
    s = inp.scores(spark, sf)
    pick = lambda x: F.when(c(x) >= 0.6, "LONG").when(c(x) <= 0.25, "SHORT").otherwise("FLAT")
    return s.withColumns({"model": pick("prob"), "cluster": pick("peak")})


PICK = "CASE WHEN {0} >= 0.6 THEN 'LONG' WHEN {0} <= 0.25 THEN 'SHORT' ELSE 'FLAT' END"
HIT = "CASE WHEN r IS NULL THEN NULL WHEN {0} = 'FLAT' THEN 1 WHEN abs(r) <= 0 THEN NULL WHEN CASE {0} WHEN 'LONG' THEN 1 ELSE -1 END * r > 0 THEN 1 ELSE 0 END"
cte("hits", "sc", f"SELECT *, {HIT.format('model')} AS mh, {HIT.format('cluster')} AS ch FROM (SELECT *, {PICK.format('prob')} AS model, {PICK.format('peak')} AS cluster, lead(close, 20) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS r FROM sc)")


@query("signal_accuracy", with_("hits", " UNION ALL ".join(
    f"SELECT '{s}' AS source, count(*) AS rows, count({h}) AS judged, {sr(f'avg({h})')} AS hit_rate, {sr(f'avg({h}) FILTER ({s} <> {chr(39)}FLAT{chr(39)})')} AS traded_hit_rate, count(*) FILTER (mh <> ch) AS disagreements FROM hits"
    for s, h in (("model", "mh"), ("cluster", "ch")))))
def _(spark, sf):
    return shown(po.signal_accuracy(two_signals(spark, sf), ["model", "cluster"]))


# ---- signals ----

@query("sig_event_long", with_("sc", f"""SELECT {KEYS}, {sr('prob')} AS event_prob, CAST(r AS BIGINT) AS event_rank FROM
  (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY prob DESC) AS r FROM sc WHERE exp_ret > -1 AND prob >= 0.5) WHERE r <= 20 AND peak > 0.4"""))
def _(spark, sf):
    d = inp.scores(spark, sf).select("ticker", "date", c("prob").alias("event_prob"), (c("exp_ret") > -1).cast("int").alias("event_pred"), (c("peak") > 0.4).cast("int").alias("direction_pred"))
    return shown(tr.event_long_signals(d).select("ticker", "date", "event_prob", "event_rank"))


@query("sig_baseline", with_("pol0", f"""SELECT {KEYS}, CAST(r AS BIGINT) AS signal_rank, CAST(CASE WHEN policy_score > 0.01 THEN 1 WHEN policy_score < -0.01 THEN -1 ELSE 0 END AS BIGINT) AS decision FROM
  (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY policy_score DESC) AS r FROM pol0 WHERE prob >= 0.5 AND exp_ret >= 1 AND exp_dd >= -3) WHERE r <= 20"""))
def _(spark, sf):
    d = po.policy_score(inp.scores(spark, sf).withColumnsRenamed(NAMES))
    d = d.select("ticker", "date", "policy_score", c("pred_rebound_prob").alias("trigger_prob"), c("pred_expected_ret_pct").alias("expected_return"), c("pred_expected_dd_pct").alias("expected_drawdown"))
    return shown(tr.baseline_signals(d).select("ticker", "date", "signal_rank", "decision"))


LONG_SIZE = sr("CASE WHEN p.action = 'LONG' THEN least(greatest(position_size, 0), 1) ELSE 0 END")


@query("sig_full", with_("pol", f"SELECT b.ticker, strftime(b.date, '%Y-%m-%d') AS date, coalesce(p.action, 'FLAT') AS action, {LONG_SIZE} AS position_size "
                         "FROM bars b LEFT JOIN (SELECT * FROM pol WHERE rn > 3) p ON p.ticker = b.ticker AND p.date = b.date"))
def _(spark, sf):
    d = bars(spark, sf).select("ticker", "date", "close")
    keep = inp.scores(spark, sf).where("rn > 3").select("ticker", "date")
    p = po.apply_policy(policy_input(spark, sf)).join(keep, ["ticker", "date"], "left_semi").select("ticker", "date", "policy_score", "position_size", "action")
    return shown(tr.full_signals(d, p).select("ticker", "date", "action", "position_size"))


# ---- trades on the dense grid ----

cte("grid0", "sc", """SELECT t.ticker, d.date, last_value(close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS close, CASE WHEN prob >= 0.6 THEN 1 ELSE 0 END AS signal,
  CASE WHEN prob >= 0.6 THEN 'LONG' WHEN prob <= 0.2 THEN 'SHORT' ELSE 'FLAT' END AS action FROM (SELECT DISTINCT date FROM bars) d, (SELECT DISTINCT ticker FROM bars) t LEFT JOIN sc p ON p.ticker = t.ticker AND p.date = d.date""")
cte("grid", "grid0", "SELECT *, coalesce(lag(signal) OVER w, 0) AS was, lag(close) OVER w AS pc FROM grid0 WHERE close IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)")
cte("tradesq", "grid", """SELECT ticker, trade, min(date) AS entry_date, arg_min(close, date) AS entry_price, max(date) AS exit_date, arg_max(close, date) AS exit_price, sum(signal) AS bars, min(signal) AS open_now,
  arg_max(close, date) * 0.999::DOUBLE / (arg_min(close, date) * 1.001::DOUBLE) - 1 AS ret FROM (SELECT *, sum(CASE WHEN signal = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS trade FROM grid)
  WHERE signal = 1 OR was = 1 GROUP BY ticker, trade""")
cte("curve0", "grid", """SELECT *, 10000 * product((CASE WHEN was = 1 THEN coalesce(close / pc, 1) ELSE 1 END) * (CASE WHEN signal = 1 AND was = 0 THEN 1 / 1.001::DOUBLE WHEN signal = 0 AND was = 1 THEN 0.999::DOUBLE ELSE 1 END)) OVER w AS equity
  FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
cte("curve1", "curve0", "SELECT *, greatest(max(equity) OVER w, 10000) AS peak, coalesce(lag(equity) OVER v, 10000) AS pe FROM curve0 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY ticker ORDER BY date)")


def traded(spark, sf):
    s = inp.scores(spark, sf)
    p = c("prob")
    g = tr.price_grid(s).where(c("close").isNotNull())
    acts = s.select("ticker", "date", F.when(p >= 0.6, 1).otherwise(0).alias("signal"), F.when(p >= 0.6, "LONG").when(p <= 0.2, "SHORT").otherwise("FLAT").alias("action"))
    return g.join(acts, ["ticker", "date"], "left").fillna({"signal": 0, "action": "FLAT"})


@query("trades_long_flat", with_("tradesq", f"""SELECT ticker, CAST(trade AS BIGINT) AS trade, strftime(entry_date, '%Y-%m-%d') AS entry_date, round(entry_price, 8) AS entry_price, strftime(exit_date, '%Y-%m-%d') AS exit_date,
  round(exit_price, 8) AS exit_price, CAST(bars AS BIGINT) AS bars, CAST(open_now AS BIGINT) AS open, round(ret, 8) AS "return", CAST(ret > 0 AS BIGINT) AS win FROM tradesq"""))
def _(spark, sf):
    return shown(tr.trades_long_flat(traded(spark, sf)), 8)


@query("equity_curve", with_("curve1", f"SELECT {KEYS}, {sr('ln(equity)', 8)} AS log_equity, {sr('equity / peak - 1', 8)} AS drawdown, CAST(was AS BIGINT) AS held FROM curve1"))
def _(spark, sf):
    return shown(tr.equity_curve(traded(spark, sf)).select("ticker", "date", F.ln("equity").alias("log_equity"), "drawdown", "held"), 8)


STATS = "return_log buy_hold_pct max_drawdown_pct exposure_pct sharpe win_rate_pct best_trade_pct worst_trade_pct avg_trade_pct profit_factor"
cte("perf", "curve1 tradesq", """SELECT * FROM (SELECT ticker, ln(arg_max(equity, date) / 10000) AS return_log, greatest(max(equity), 10000) AS equity_peak, min(equity / peak - 1) * 100 AS max_drawdown_pct, avg(was) * 100 AS exposure_pct,
  avg(equity / pe - 1) / nullif(stddev_samp(equity / pe - 1), 0) * sqrt(52) AS sharpe, (arg_max(close, date) / arg_min(close, date) - 1) * 100 AS buy_hold_pct FROM curve1 GROUP BY ticker) LEFT JOIN
  (SELECT ticker, count(*) AS trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) * 100 AS win_rate_pct, max(ret) * 100 AS best_trade_pct, min(ret) * 100 AS worst_trade_pct, avg(ret) * 100 AS avg_trade_pct,
  sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(-sum(CASE WHEN ret < 0 THEN ret ELSE 0 END), 0) AS profit_factor FROM tradesq GROUP BY ticker) USING (ticker)""")


def stats(spark, sf):
    return tr.perf_stats(traded(spark, sf)).withColumn("return_log", F.ln(c("equity_final") / 10000))


@query("perf_stats", with_("perf", "SELECT ticker, CAST(coalesce(trades, 0) AS BIGINT) AS trades, " + ", ".join(f"{sr(k, 5)} AS {k}" for k in STATS.split()) + " FROM perf"))
def _(spark, sf):
    return shown(stats(spark, sf).select("ticker", "trades", *STATS.split()), 5)


@query("perf_basic", with_("grid", f"""SELECT ticker, round(arg_min(close, date), 8) AS initial_price, round(arg_max(close, date), 8) AS final_price, count(*) AS rows, strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date,
  count(*) FILTER (action = 'LONG') AS long_signals, count(*) FILTER (action = 'SHORT') AS short_signals, count(*) FILTER (action = 'FLAT') AS flat_signals, {sr('(arg_max(close, date) / arg_min(close, date) - 1) * 100')} AS total_return_pct FROM grid GROUP BY ticker"""))
def _(spark, sf):
    return shown(tr.perf_basic(traded(spark, sf)), {"*": 6, "initial_price": 8, "final_price": 8})


RESULT_COLS = ["max_drawdown_pct", "exposure_pct", "sharpe", "win_rate_pct", "profit_factor", "trades", "buy_hold_pct"]


def agg_sql(where: str, count: bool) -> str:
    return with_("perf", " UNION ALL ".join(
        f"SELECT '{k}' AS statistic, {f'count({k}) AS count, ' if count else ''}{sr(f'avg({k})', 4)} AS mean, {sr(f'median({k})', 4)} AS median FROM perf {where}" for k in RESULT_COLS))


@query("agg_mean_median", agg_sql("", False))
def _(spark, sf):
    return shown(mt.mean_median(stats(spark, sf), RESULT_COLS).drop("count"), 4)


@query("agg_robust", agg_sql("WHERE trades >= 30 AND abs(max_drawdown_pct) >= 1", True))
def _(spark, sf):
    return shown(mt.mean_median(stats(spark, sf), RESULT_COLS, min_trades=30), 4)


# ---- metrics ----

cte("mb", "bm sc", "SELECT bm.*, sc.prob, sc.exp_ret, sc.exp_dd, sc.peak, CASE WHEN sc.prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM bm JOIN sc USING (ticker, date)")


def judged(spark, sf):
    d = lab.label_big_move(atr_v1(inp.scores(spark, sf)))
    return d.select("ticker", "date", "big_move_event", "prob", "peak", F.when(c("prob") >= 0.5, 1).otherwise(0).alias("pred"))


@query("metric_confusion", with_("mb", f"""SELECT tp, fp, tn, fn, {sr('(tp + tn) / (tp + fp + tn + fn)')} AS accuracy, {sr('tp / (tp + fp)')} AS "precision", {sr('tp / (tp + fn)')} AS recall, {sr('2 * tp / (2 * tp + fp + fn)')} AS f1,
  {sr('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS balanced_accuracy FROM (SELECT count(*) FILTER (big_move_event = 1 AND pred = 1) AS tp, count(*) FILTER (big_move_event = 0 AND pred = 1) AS fp, count(*) FILTER (big_move_event = 0 AND pred = 0) AS tn, count(*) FILTER (big_move_event = 1 AND pred = 0) AS fn FROM mb)"""))
def _(spark, sf):
    return shown(mt.confusion(judged(spark, sf), "big_move_event", "pred"))


@query("metric_roc_auc", with_("mb", f"SELECT {sr('(sum(r) FILTER (big_move_event = 1) - p * (p + 1) / 2) / (p * (n - p))', 8)} AS roc_auc FROM (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS r, "
       "count(*) OVER () AS n, sum(big_move_event) OVER () AS p FROM mb) GROUP BY p, n"))
def _(spark, sf):
    return shown(mt.roc_auc(judged(spark, sf), "big_move_event", "prob"), 8)


cte("prc", "mb", "SELECT prob, tp, tp / (tp + fp) AS precision, tp / max(tp) OVER () AS recall FROM (SELECT prob, sum(sum(big_move_event)) OVER (ORDER BY prob DESC) AS tp, sum(sum(1 - big_move_event)) OVER (ORDER BY prob DESC) AS fp FROM mb GROUP BY prob)")


@query("metric_pr_auc", with_("prc", f"""SELECT {sr('sum((recall - pr) * ("precision" + pp) / 2)', 8)} AS pr_auc, {sr('sum((recall - pr) * "precision")', 8)} AS average_precision FROM
  (SELECT *, coalesce(lag(recall) OVER (ORDER BY prob DESC), 0) AS pr, coalesce(lag("precision") OVER (ORDER BY prob DESC), 1) AS pp FROM prc)"""))
def _(spark, sf):
    return shown(mt.pr_auc(judged(spark, sf), "big_move_event", "prob"), 8)


@query("metric_precision_at_k", with_("mb", f"""SELECT CAST(k AS BIGINT) AS k, CAST(sum(big_move_event) FILTER (r <= k) AS BIGINT) AS hits, {sr('sum(big_move_event) FILTER (r <= k) / k')} AS "precision", {sr('sum(big_move_event) FILTER (r <= k) / sum(big_move_event)')} AS recall
  FROM (SELECT *, row_number() OVER (ORDER BY prob DESC, ticker, date) AS r FROM mb), (SELECT unnest([1, 3, 5, 10, 20]) AS k) GROUP BY k"""))
def _(spark, sf):
    return shown(mt.precision_at_k(judged(spark, sf), "big_move_event", "prob"))


@query("threshold_curve", with_("mb", f"""SELECT t AS threshold, picked, hits, {sr('prec')} AS "precision", CAST(CASE WHEN row_number() OVER (ORDER BY CASE WHEN prec >= 0.4 THEN 0 ELSE 1 END, CASE WHEN prec >= 0.4 THEN t END, prec DESC, t) = 1 THEN 1 ELSE 0 END AS BIGINT) AS chosen FROM
  (SELECT t, count(*) FILTER (prob >= t) AS picked, count(*) FILTER (prob >= t AND big_move_event = 1) AS hits, coalesce(count(*) FILTER (prob >= t AND big_move_event = 1) / nullif(count(*) FILTER (prob >= t), 0), 0) AS prec
   FROM mb, (SELECT i / 100::DOUBLE AS t FROM (SELECT unnest(generate_series(1, 99)) AS i)) GROUP BY t)"""))
def _(spark, sf):
    return shown(mt.threshold_curve(judged(spark, sf), "big_move_event", "prob"))


@query("metric_brier", with_("mb", f"SELECT {sr('avg(power(prob - big_move_event, 2))', 8)} AS brier_prob, {sr('avg(power(peak - big_move_event, 2))', 8)} AS brier_peak FROM mb"))
def _(spark, sf):
    return shown(mt.brier(judged(spark, sf), "big_move_event", ["prob", "peak"]), 8)


@query("metric_regression", with_("rd sc", f"SELECT {sr('avg(abs(ret_5d_pct - exp_ret))')} AS mae_ret, {sr('avg(abs(dd_5d_pct - exp_dd))')} AS mae_dd, {sr('avg(prob)')} AS mean_prob FROM rd JOIN sc USING (ticker, date)"))
def _(spark, sf):
    d = lab.ret_dd(inp.scores(spark, sf))
    return shown(mt.regression(d, {"mae_ret": ("ret_5d_pct", "exp_ret"), "mae_dd": ("dd_5d_pct", "exp_dd")}, ["prob"]))


# ---- feature analytics ----

FEATURES = ["ret_5", "atr14", "rsi14", "volume", "turnover"]


def labelled_features(spark, sf):
    d = lab.label_cls(rsi_v1(atr_v1(returns(bars(spark, sf)))), 1, 0.5)
    return d.select("ticker", "date", "label_1d_cls", *FEATURES)


cte("fl", "v1 lab", "SELECT v1.ticker, v1.date, label_1d_cls AS y, " + ", ".join(f"v1.{k}" for k in FEATURES) + " FROM v1 JOIN lab USING (ticker, date)")
cte("long", "fl", " UNION ALL ".join(f"SELECT ticker, date, y, '{k}' AS feature, {k} AS value FROM fl" for k in FEATURES))


@query("melt_features", with_("long", f"SELECT feature, count(*) AS rows, count(value) AS known, {sr('sum(value)', 2)} AS total FROM long WHERE feature IN ('volume', 'turnover') GROUP BY feature"))
def _(spark, sf):
    d = an.melt_features(labelled_features(spark, sf).withColumn("turnover", F.round("turnover", 2)), ["volume", "turnover"], ["date", "ticker"])
    total = F.sum(c("value").cast("decimal(20,2)")).cast("double")
    return shown(d.groupBy("feature").agg(F.count("*").alias("rows"), F.count("value").alias("known"), total.alias("total")), 2)


cte("eps0", "long", "SELECT date, feature, quantile_cont(value, 0.8) AS hi, quantile_cont(value, 0.2) AS lo, count(*) AS n, avg(value) FILTER (y = 1) AS p, avg(value) FILTER (y = -1) AS m FROM long WHERE value IS NOT NULL GROUP BY date, feature")
cte("epsc", "eps0 long", """SELECT date, feature, avg(CASE WHEN y <> 0 THEN 1.0 ELSE 0 END) FILTER (value >= hi) - avg(CASE WHEN y <> 0 THEN 1.0 ELSE 0 END) FILTER (value <= lo) AS event_pred_score,
  CASE WHEN any_value(p) IS NULL OR any_value(m) IS NULL THEN 0.5 WHEN any_value(p) > any_value(m) THEN 1 ELSE 0 END AS direction_accuracy FROM long JOIN eps0 USING (date, feature) WHERE value IS NOT NULL AND n >= 10 GROUP BY date, feature""")


def event_scores(spark, sf):
    return an.event_pred_score(labelled_features(spark, sf), FEATURES, "label_1d_cls")


@query("event_pred_score", with_("epsc", f"SELECT strftime(date, '%Y-%m-%d') AS date, feature, {sr('event_pred_score')} AS event_pred_score, CAST(direction_accuracy AS DOUBLE) AS direction_accuracy FROM epsc"))
def _(spark, sf):
    return shown(event_scores(spark, sf))


cte("evsum", "epsc", "SELECT *, abs(event_pred_mean) * direction_acc_mean AS success_rate FROM (SELECT feature, count(*) AS n_days, avg(event_pred_score) AS event_pred_mean, avg(direction_accuracy) AS direction_acc_mean, "
    "avg(CASE WHEN event_pred_score > 0 THEN 1.0 ELSE 0 END) AS positive_pred_rate FROM epsc GROUP BY feature)")


@query("event_pred_summary", with_("evsum", "SELECT feature, n_days, " + ", ".join(f"{sr(k)} AS {k}" for k in ("event_pred_mean", "direction_acc_mean", "positive_pred_rate", "success_rate")) + " FROM evsum"))
def _(spark, sf):
    return shown(an.event_pred_summary(event_scores(spark, sf)))


MA = "CASE WHEN count({0}) OVER f >= 30 THEN avg({0}) OVER f END"
FW = "WINDOW f AS (PARTITION BY feature ORDER BY date ROWS 29 PRECEDING)"


@query("event_pred_rolling", with_("epsc", f"SELECT strftime(date, '%Y-%m-%d') AS date, feature, {sr(MA.format('event_pred_score'))} AS event_pred_ma30, {sr(MA.format('direction_accuracy'))} AS direction_acc_ma30 FROM epsc {FW}"))
def _(spark, sf):
    d = an.with_rolling_means(event_scores(spark, sf), {"event_pred_score": "event_pred_ma30", "direction_accuracy": "direction_acc_ma30"})
    return shown(d.drop("event_pred_score", "direction_accuracy"))


@query("agg_monthly_perf", with_("epsc", f"SELECT year_month, feature, {sr('a')} AS monthly_event_pred_mean, {sr('b')} AS monthly_direction_acc_mean, days_in_month, {sr('abs(a) * b')} AS monthly_success_rate FROM "
       "(SELECT strftime(date, '%Y-%m') AS year_month, feature, avg(event_pred_score) AS a, avg(direction_accuracy) AS b, count(*) AS days_in_month FROM epsc GROUP BY ALL)"))
def _(spark, sf):
    return shown(an.monthly_event_perf(event_scores(spark, sf)))


cte("busy", "fl", "SELECT date FROM fl GROUP BY date HAVING count(*) >= 20 AND count(*) FILTER (y <> 0) >= 10")
cte("dl", "long busy", "SELECT * FROM long WHERE y <> 0 AND value IS NOT NULL AND date IN (SELECT date FROM busy)")
cte("ds0", "dl", "SELECT date, feature, avg(value) FILTER (y = 1) AS p, avg(value) FILTER (y = -1) AS m, stddev_samp(value) FILTER (y = 1) AS sp, stddev_samp(value) FILTER (y = -1) AS sm FROM dl GROUP BY ALL "
    "HAVING count(*) >= 10 AND count(*) FILTER (y = 1) >= 3 AND count(*) FILTER (y = -1) >= 3")
cte("dsc", "ds0 dl", "SELECT date, feature, abs(p - m) / ((sp + sm) / 2 + 1e-9) AS direction_pred_score, avg(CASE WHEN CASE WHEN value > (p + m) / 2 THEN 1 ELSE -1 END = y THEN 1.0 ELSE 0 END) AS direction_accuracy, "
    "abs(p - m) / (sp + sm + 1e-9) AS class_separation FROM dl JOIN ds0 USING (date, feature) GROUP BY date, feature, p, m, sp, sm")


def dir_scores(spark, sf):
    return an.direction_score(labelled_features(spark, sf), FEATURES, "label_1d_cls")


@query("direction_score", with_("dsc", "SELECT strftime(date, '%Y-%m-%d') AS date, feature, " + ", ".join(f"{sr(k)} AS {k}" for k in ("direction_pred_score", "direction_accuracy", "class_separation")) + " FROM dsc"))
def _(spark, sf):
    return shown(dir_scores(spark, sf))


cte("dsum", "dsc", "SELECT *, direction_acc_mean * class_sep_mean AS success_rate FROM (SELECT feature, count(*) AS n_days, avg(direction_pred_score) AS direction_pred_mean, avg(direction_accuracy) AS direction_acc_mean, avg(class_separation) AS class_sep_mean FROM dsc GROUP BY feature)")
DS = ("direction_pred_mean", "direction_acc_mean", "class_sep_mean", "success_rate")


@query("direction_summary", with_("dsum", "SELECT feature, n_days, " + ", ".join(f"{sr(k)} AS {k}" for k in DS) + " FROM dsum"))
def _(spark, sf):
    return shown(an.direction_summary(dir_scores(spark, sf)))


@query("direction_rolling", with_("dsc", "SELECT strftime(date, '%Y-%m-%d') AS date, feature, " + ", ".join(f"{sr(MA.format(k))} AS {o}" for k, o in (("direction_pred_score", "direction_pred_ma30"), ("class_separation", "class_sep_ma30"))) + f" FROM dsc {FW}"))
def _(spark, sf):
    d = an.with_rolling_means(dir_scores(spark, sf), {"direction_pred_score": "direction_pred_ma30", "class_separation": "class_sep_ma30"})
    return shown(d.select("date", "feature", "direction_pred_ma30", "class_sep_ma30"))


@query("monthly_direction_perf", with_("dsc", f"SELECT year_month, feature, {sr('a')} AS monthly_direction_acc_mean, {sr('b')} AS monthly_direction_pred_mean, {sr('s')} AS monthly_class_sep_mean, days_in_month, {sr('a * s')} AS monthly_success_rate FROM "
       "(SELECT strftime(date, '%Y-%m') AS year_month, feature, avg(direction_accuracy) AS a, avg(direction_pred_score) AS b, avg(class_separation) AS s, count(*) AS days_in_month FROM dsc GROUP BY ALL)"))
def _(spark, sf):
    return shown(an.monthly_direction_perf(dir_scores(spark, sf)))


@query("recommend_features", with_("dsum", f"SELECT feature, n_days, {sr('success_rate')} AS success_rate FROM dsum WHERE n_days >= 50 AND success_rate >= 0.05 AND direction_acc_mean >= 0.5 ORDER BY success_rate DESC, feature LIMIT 10"))
def _(spark, sf):
    d = an.recommend_features(an.direction_summary(dir_scores(spark, sf)), 50, 0.05, 0.5)
    return shown(d.select("feature", "n_days", "success_rate"))


@query("top_features", with_("evsum", f"SELECT feature, {sr('success_rate')} AS success_rate FROM evsum WHERE n_days >= 30 OR (SELECT max(n_days) FROM evsum) < 30 ORDER BY success_rate DESC, feature LIMIT 3"))
def _(spark, sf):
    return shown(an.top_features(an.event_pred_summary(event_scores(spark, sf)), 3).select("feature", "success_rate"))
