"""Queries for the explorer block, episodes and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import c
from ..operators import episodes as ep
from ..operators import explorer as x
from ..operators import regimes as rg
from ..operators.clean import dropna_prefix
from ..operators.splits import seq_windows
from ..sources import lake
from . import inputs as inp
from .inputs import bars, table
from .registry import cte, panel_query, query, shown, sr, with_
from .sql_panel import F1, L, Q, R, WIN, Z, ewm_step, step

P = 4
EXACT = 8

# ---- SQL of the explorer block ----
step("x0", "macds", x_return=f"{Q('close', L('close'))} - 1", x_log_return=f"ln(close / {L('close')})", x_vol_roc=f"{Q('volume', L('volume'))} - 1",
     gain0="CASE WHEN chg > 0 THEN chg WHEN chg <= 0 THEN 0.0::DOUBLE END", loss0="CASE WHEN chg < 0 THEN -chg WHEN chg >= 0 THEN 0.0::DOUBLE END",
     x_ema_spread="ema5 - ema20", x_delta_macd=f"macd - {L('macd')}", nchg="count(chg) OVER wu")
ewm_step("x1", "x0", g14=("gain0", 1 / 14), s14=("loss0", 1 / 14), g7=("gain0", 1 / 7), s7=("loss0", 1 / 7), x_atr_14=("tr", 1 / 14))


def wilder(n: int) -> str:
    return (f"CASE WHEN nchg < {n} THEN NULL WHEN s{n} = 0 THEN CASE WHEN g{n} > 0 THEN 100.0::DOUBLE END "
            f"ELSE least(greatest(100 - 100 / (1 + g{n} / nullif(s{n}, 0)), 0.0), 100.0) END")


step("x2", "x1", x_vol_roc_neg="CASE WHEN x_vol_roc < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", x_rsi_14=wilder(14), x_rsi_7=wilder(7),
     x_delta_ema_spread=f"x_ema_spread - {L('x_ema_spread')}", x_delta_atr_3=f"x_atr_14 - {L('x_atr_14', 3)}", x_delta_atr_5=f"x_atr_14 - {L('x_atr_14', 5)}",
     x_bb_mid=R("avg", "close", 20), xsd=R("stddev_pop", "close", 20), x_volume_z=Z("volume", 60), x_atr_over_ema20=Q("x_atr_14", "ema20"),
     x_local_vol_index=Q(R("stddev_pop", "x_return", 5), R("stddev_pop", "x_return", 20)), x_volume_adjusted_atr=Q("x_atr_14", "ln(nullif(volume, 0))"),
     x_ema_atr_corr_20="CASE WHEN count(x_atr_14) OVER w20 >= 20 THEN corr(ema5, x_atr_14) OVER w20 END",
     x_atr_rel=Q("x_atr_14", R("avg", "x_atr_14", 20, 5)), x_ema_spread_rel=Q("x_ema_spread", "ema20"), x_macd_hist_rel=Q("macd_hist", R("stddev_pop", "macd_hist", 15, 5)),
     x_close_scaled="CASE WHEN max(close) OVER (PARTITION BY ticker) - min(close) OVER (PARTITION BY ticker) <= 1e-8 THEN 0.5 ELSE (close - min(close) OVER (PARTITION BY ticker)) / (max(close) OVER (PARTITION BY ticker) - min(close) OVER (PARTITION BY ticker)) END",
     x_volume_scaled="CASE WHEN max(volume) OVER (PARTITION BY ticker) - min(volume) OVER (PARTITION BY ticker) <= 1e-8 THEN 0.5 ELSE (volume - min(volume) OVER (PARTITION BY ticker)) / (max(volume) OVER (PARTITION BY ticker) - min(volume) OVER (PARTITION BY ticker)) END")
step("x3", "x2", x_delta_rsi=f"x_rsi_14 - {L('x_rsi_14')}", x_delta_rsi_3=f"x_rsi_14 - {L('x_rsi_14', 3)}", x_bb_upper="x_bb_mid + 2 * xsd", x_bb_lower="x_bb_mid - 2 * xsd",
     xbw="(x_bb_mid + 2 * xsd) - (x_bb_mid - 2 * xsd)", x_rsi_local_z=Z("x_rsi_14", 20), x_delta_ema_spread_x_delta_atr="x_delta_ema_spread * x_delta_atr_5",
     x_trend_momentum_divergence="macd - x_rsi_14", x_delta_atr_rel=Q("x_delta_atr_3", R("stddev_pop", "x_atr_14", 10, 4)))
step("x4", "x3", x_pos_in_band="CASE WHEN abs(xbw) > 1e-9 THEN least(greatest((close - x_bb_lower) / nullif(xbw, 0), 0.0), 1.0) END", x_bb_width="xbw / x_bb_mid",
     x_delta_rsi_x_delta_macd="x_delta_rsi_3 * x_delta_macd", x_pos_in_band_rel=Q("close - x_bb_mid", "xbw"), x_delta_rsi_rel=Q("x_delta_rsi", R("stddev_pop", "x_rsi_14", 10, 4)))
step("x5", "x4", x_bb_width_delta_5=f"{Q('x_bb_width', L('x_bb_width', 5))} - 1", x_event_local_vol_spike=F1("x_local_vol_index > 1.5"),
     x_event_rebound_candidate=F1("x_pos_in_band < 0.35 AND x_delta_rsi_3 > 0 AND x_delta_macd > 0 AND x_volume_z > 0"),
     x_event_volume_regain=F1("x_volume_z > 0.8 AND x_vol_roc > 0 AND x_delta_rsi > 0"),
     x_event_exhaustion_candidate=F1("x_pos_in_band > 0.85 AND x_delta_ema_spread < 0 AND x_delta_atr_5 > 0 AND x_volume_z < 0.5"),
     x_event_breakdown_risk=F1("x_local_vol_index > 1.2 AND macd_hist < 0 AND x_delta_rsi < 0"),
     pos="row_number() OVER w - 1")

panel_query("x_return", x.x_returns, "x2", "x_return x_log_return x_vol_roc x_vol_roc_neg")
X_EMA = {"x_ema_5": "ema5", "x_ema_20": "ema20", "x_macd": "macd", "x_macd_signal": "macd_signal", "x_macd_hist": "macd_hist"}
cte("x5n", "x5", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in X_EMA.items()) + " FROM x5")
panel_query("x_ema_macd", x.x_ema_macd, "x5n", "x_ema_5 x_ema_20 x_ema_spread x_delta_ema_spread x_macd x_macd_signal x_macd_hist x_delta_macd", P)
panel_query("x_rsi_wilder", x.x_wilder, "x5", "x_rsi_14 x_rsi_7 x_delta_rsi x_delta_rsi_3", P)
panel_query("x_atr_wilder", x.x_wilder, "x5", "x_atr_14 x_delta_atr_3 x_delta_atr_5", P)
panel_query("x_bollinger", x.x_bollinger, "x5", "x_bb_mid x_bb_upper x_bb_lower x_pos_in_band x_bb_width x_bb_width_delta_5", P)
panel_query("x_rolling_z", x.explorer_core, "x5", "x_volume_z x_rsi_local_z", P)
panel_query("x_interactions", x.explorer_core, "x5",
            "x_atr_over_ema20 x_delta_rsi_x_delta_macd x_delta_ema_spread_x_delta_atr x_trend_momentum_divergence x_volume_adjusted_atr", 2)
panel_query("x_local_vol_index", x.explorer_core, "x5", "x_local_vol_index")
panel_query("x_ema_atr_corr_20", x.explorer_core, "x5", "x_ema_atr_corr_20")
panel_query("x_event_relatives", x.explorer_core, "x5", "x_pos_in_band_rel x_atr_rel x_delta_atr_rel x_delta_rsi_rel x_ema_spread_rel x_macd_hist_rel", P)
panel_query("x_minmax", x.x_minmax, "x5", "x_close_scaled x_volume_scaled")
panel_query("x_events", x.explorer_core, "x5", "", ints=" ".join(x.EVENT_ORDER))
ewm_step("x6", "x5", xre=("x_rsi_14", 2 / 6), x_atr_smooth=("x_atr_rel", 2 / 4), x_macd_smooth=("macd_hist", 2 / 5), x_volume_z_smooth=("x_volume_z", 2 / 5),
         x_ema_spread_smooth=("x_ema_spread_rel", 2 / 5))
GAUSS = {e: "least(greatest((" + " + ".join(f"exp(-0.5 * {k * k}::DOUBLE / 4) * {'lag' if k < 0 else 'lead'}({src}, {abs(k)}, 0) OVER w" for k in range(-6, 7))
         + ") / (" + " + ".join(f"exp(-0.5 * {k * k}::DOUBLE / 4)" for k in range(-6, 7)) + "), 0.0), 1.0)"
         for e, src in (("x_label_buy_soft", "x_event_rebound_candidate"), ("x_label_sell_soft", "x_event_breakdown_risk"))}
step("x7", "x6", x_rsi_smooth="CASE WHEN count(xre) OVER w3 >= 1 THEN median(xre) OVER w3 END", **GAUSS)
panel_query("x_smoothers", lambda d: x.x_smoothers(x.explorer_core(d)), "x7", "x_rsi_smooth x_atr_smooth x_macd_smooth x_volume_z_smooth x_ema_spread_smooth", P)
panel_query("x_gauss_labels", lambda d: x.x_gauss_labels(x.explorer_core(d)), "x7", "x_label_buy_soft x_label_sell_soft")

# Episodes in SQL the direct way: number the events, expand what each claims, keep the smallest number per bar.
cte("ev", "x7", "SELECT ticker, kind, pos, row_number() OVER (PARTITION BY ticker ORDER BY k, pos) - 1 AS id FROM (" + " UNION ALL ".join(
    f"SELECT ticker, '{e[2:]}' AS kind, {i} AS k, pos FROM x7 WHERE {e} = 1" for i, e in enumerate(x.EVENT_ORDER)) + ")")
cte("claim", "ev", "SELECT ticker, p, min(id) AS id, arg_min(kind, id) AS kind FROM (SELECT ticker, id, kind, unnest(generate_series(pos - 5, pos + 5)) AS p FROM ev) GROUP BY ticker, p")
cte("x8", "x7 claim", "SELECT x7.*, coalesce(c.id, -1) AS episode_id, coalesce(c.kind || ':' || c.id, '') AS episode_label FROM x7 LEFT JOIN claim c ON c.ticker = x7.ticker AND c.p = x7.pos")


def explored(spark, sf):
    return x.explorer_features(bars(spark, sf))


@query("episode_assign", with_("x8", "SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CAST(episode_id AS BIGINT) AS episode_id, episode_label FROM x8"))
def _(spark, sf):
    return shown(ep.episode_assign(x.explorer_core(bars(spark, sf))).select("ticker", "date", "episode_id", "episode_label"))


NORMS = {"x_rsi_local_norm": "x_rsi_14", "x_atr_local_norm": "x_atr_rel", "x_macd_local_norm": "macd_hist", "x_ema_spread_local_norm": "x_ema_spread_rel"}
cte("x9", "x8", "SELECT *, " + ", ".join(
    f"coalesce(CASE WHEN episode_id >= 0 THEN CASE WHEN {v} IS NULL THEN NULL WHEN stddev_pop({v}) OVER e <= 1e-8 THEN 0 ELSE ({v} - avg({v}) OVER e) / nullif(stddev_pop({v}) OVER e, 0) END END, {Z(v, 15)}) AS {k}"
    for k, v in NORMS.items()) + f" FROM x8 {WIN}, e AS (PARTITION BY ticker, episode_id)")
panel_query("episode_zscore", x.explorer_features, "x9", " ".join(NORMS), P)
panel_query("explorer_features", x.explorer_features, "x9", "x_rsi_smooth x_macd_smooth x_label_buy_soft x_close_scaled", P, ints="episode_id")

STAT_SQL = {"close": "close", "volume_z": "x_volume_z", "rsi_smooth": "x_rsi_smooth", "atr_smooth": "x_atr_smooth", "local_vol_index": "x_local_vol_index"}
cte("eps", "x8", "SELECT ticker, episode_id, split_part(min(episode_label), ':', 1) AS event_type, min(episode_label) AS episode_label, min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days, "
    "(arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 AS price_change_pct, (max(high) - min(low)) / min(low) * 100 AS max_price_range_pct, "
    + ", ".join(f"avg({v}) AS {k}_mean, CASE WHEN count({v}) > 1 THEN stddev_samp({v}) WHEN count({v}) = 1 THEN 0 END AS {k}_std, arg_min({v}, date) FILTER ({v} IS NOT NULL) AS {k}_start, arg_max({v}, date) FILTER ({v} IS NOT NULL) AS {k}_end" for k, v in STAT_SQL.items())
    + ", sum(x_event_breakdown_risk) AS breakdown_active, avg(x_label_buy_soft) AS buy_soft_mean FROM x8 WHERE episode_id >= 0 GROUP BY ticker, episode_id")


def extracted(spark, sf):
    return ep.episode_extract(explored(spark, sf))


EXTRA = [f"{k}_{s}" for k in STAT_SQL for s in ("mean", "std", "start", "end")]


@query("episode_extract", with_("eps", "SELECT ticker, CAST(episode_id AS BIGINT) AS episode_id, event_type, episode_label, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, "
       f"duration_days, {sr('price_change_pct', P)} AS price_change_pct, {sr('max_price_range_pct', P)} AS max_price_range_pct, " + ", ".join(f"{sr(k, 3)} AS {k}" for k in EXTRA)
       + f", CAST(breakdown_active AS BIGINT) AS breakdown_active, {sr('buy_soft_mean', 3)} AS buy_soft_mean FROM eps"))
def _(spark, sf):
    d = extracted(spark, sf)
    stats = [F.col("feature_statistics")[k][s].alias(f"{k}_{s}") for k in STAT_SQL for s in ("mean", "std", "start", "end")]
    d = d.select("ticker", "episode_id", "event_type", "episode_label", "start_date", "end_date", "duration_days", "price_change_pct", "max_price_range_pct", *stats,
                 F.col("event_signals")["event_breakdown_risk"]["active_periods"].alias("breakdown_active"),
                 F.col("event_signals")["label_buy_soft"]["avg_intensity"].alias("buy_soft_mean"))
    return shown(d, {"*": 3, "price_change_pct": P, "max_price_range_pct": P})


@query("episode_summary", with_("eps", f"SELECT kind, key, count(*) AS episodes, {sr('avg(duration_days)')} AS avg_length FROM (SELECT 'event_type' AS kind, event_type AS key, duration_days FROM eps "
       "UNION ALL SELECT 'ticker', ticker, duration_days FROM eps UNION ALL SELECT 'all', 'all', duration_days FROM eps) GROUP BY kind, key"))
def _(spark, sf):
    return shown(ep.episode_summary(extracted(spark, sf)))


@query("episodes_source", with_("eps", "SELECT ticker, CAST(episode_id AS BIGINT) AS episode_id, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, "
       f"{sr('price_change_pct', P)} AS price_change_pct, {sr('close_mean', P)} AS close_mean FROM eps"))
def _(spark, sf):
    path = lake.new_folder(spark, "episodes")
    d = extracted(spark, sf).withColumns({"mode": F.lit("buyer"), "start_date": F.date_format("start_date", "yyyy-MM-dd"), "end_date": F.date_format("end_date", "yyyy-MM-dd")})
    lake.write_table(d, path, "json")
    r = lake.episodes_source(spark, path)
    return shown(r.select("ticker", "episode_id", "start_date", "end_date", "price_change_pct", F.col("feature_statistics")["close"]["mean"].alias("close_mean")), P)


PC = "price_change_pct"
WR = f"avg(CASE WHEN {PC} > 0 THEN 1.0 ELSE 0.0 END) * 100"


@query("ep_performance", with_("eps", f"SELECT event_type, count(*) AS total_episodes, {sr(f'avg({PC})', P)} AS avg_price_change, {sr(f'median({PC})', P)} AS median_price_change, {sr(f'stddev_samp({PC})', P)} AS std_price_change, "
       f"count(*) FILTER ({PC} > 0) AS positive_episodes, {sr(WR, P)} AS success_rate, {sr('avg(duration_days)', P)} AS avg_duration, {sr(f'sum({PC})', 3)} AS total_return FROM eps GROUP BY event_type"))
def _(spark, sf):
    return shown(ep.ep_performance(extracted(spark, sf)), {"*": P, "total_return": 3})


@query("ep_equal_stake", with_("eps", f"SELECT event_type, 10000.0::DOUBLE AS initial_capital, {sr(f'10000 + 100 * avg({PC})', 3)} AS final_capital, {sr(f'100 * avg({PC})', 3)} AS total_return, {sr(f'avg({PC})', 3)} AS total_return_pct, "
       f"count(*) AS num_trades, {sr(f'100 * avg({PC}) / count(*)', 3)} AS avg_return_per_trade FROM eps GROUP BY event_type"))
def _(spark, sf):
    return shown(ep.ep_equal_stake(extracted(spark, sf)), 3)


cte("risk", "eps", f"SELECT event_type, count(*) AS n, CASE WHEN count(*) > 1 AND stddev_samp({PC}) > 0 THEN avg({PC}) / stddev_samp({PC}) ELSE 0 END AS sharpe_ratio, min({PC}) AS max_drawdown, {WR} AS win_rate, "
    f"CASE WHEN count(*) > 1 THEN stddev_samp({PC}) ELSE 0 END AS volatility, max({PC}) AS best_trade, min({PC}) AS worst_trade, avg({PC}) AS mean FROM eps GROUP BY event_type")


@query("ep_risk", with_("risk", "SELECT event_type, " + ", ".join(f"{sr(k, P)} AS {k}" for k in ("sharpe_ratio", "max_drawdown", "win_rate", "volatility", "best_trade", "worst_trade")) + " FROM risk"))
def _(spark, sf):
    return shown(ep.ep_risk(extracted(spark, sf)).drop("total_episodes", "avg_price_change"), P)


@query("ep_recommend", with_("risk", f"SELECT event_type, CAST(s AS DOUBLE) AS recommendation_score, CASE WHEN s >= 4 THEN '{ep.VERDICTS[0]}' WHEN s >= 3 THEN '{ep.VERDICTS[1]}' WHEN s >= 2 THEN '{ep.VERDICTS[2]}' ELSE '{ep.VERDICTS[3]}' END AS recommendation, "
       f"{sr('mean', P)} AS expected_return FROM (SELECT *, CASE WHEN mean > 0 THEN 2 ELSE 0 END + CASE WHEN sharpe_ratio > 0.5 THEN 2 WHEN sharpe_ratio > 0 THEN 1 ELSE 0 END + CASE WHEN win_rate > 60 THEN 1 WHEN win_rate > 50 THEN 0.5 ELSE 0 END "
       "+ CASE WHEN max_drawdown > -5 THEN 1 WHEN max_drawdown > -10 THEN 0.5 ELSE 0 END + CASE WHEN n >= 5 THEN 1 WHEN n >= 3 THEN 0.5 ELSE 0 END AS s FROM risk)"))
def _(spark, sf):
    return shown(ep.ep_recommend(extracted(spark, sf)).select("event_type", "recommendation_score", "recommendation", "expected_return"), P)


@query("ep_redistribute", with_("risk", f"SELECT event_type, n AS count, {sr('mean', P)} AS avg_return, {sr('win_rate', P)} AS win_rate, CASE WHEN mean > 0.5 THEN 'buyer' WHEN mean < -0.5 THEN 'seller' ELSE 'neutral' END AS side FROM risk"))
def _(spark, sf):
    return shown(ep.ep_redistribute(extracted(spark, sf)).select("event_type", "count", "avg_return", "win_rate", "side"), P)


@query("ep_report")
def _(spark, sf):
    return ep.ep_report(extracted(spark, sf))


REPORT = {"total": "$.overall_statistics.total_episodes", "tickers": "$.metadata.tickers_analyzed", "win_rate": "$.overall_statistics.overall_win_rate", "duration": "$.overall_statistics.avg_episode_duration",
          "mean": "$.overall_statistics.avg_price_change", "median": "$.overall_statistics.median_price_change", "best": "$.best_performing_episode.price_change_pct",
          "worst": "$.worst_performing_episode.price_change_pct", "buyers": "$.event_performance.redistribution_summary.buyer_count",
          "sellers": "$.event_performance.redistribution_summary.seller_count", "types": "$.event_performance.redistribution_summary.total_events", "fifth": "$.top_performing_episodes[4].price_change_pct",
          "first_sharpe": "$.risk_metrics[0].sharpe_ratio", "first_date": "$.metadata.date_range.first_date"}


@query("ep_report_fields", with_("eps risk", f"""SELECT (SELECT count(*) FROM eps) AS total, (SELECT count(DISTINCT ticker) FROM eps) AS tickers, {sr(f'(SELECT {WR} FROM eps)', P)} AS win_rate, {sr('(SELECT avg(duration_days) FROM eps)', P)} AS duration,
  {sr(f'(SELECT avg({PC}) FROM eps)', P)} AS mean, {sr(f'(SELECT median({PC}) FROM eps)', P)} AS median, {sr(f'(SELECT max({PC}) FROM eps)', P)} AS best, {sr(f'(SELECT min({PC}) FROM eps)', P)} AS worst,
  (SELECT count(*) FROM risk WHERE mean > 0.5) AS buyers, (SELECT count(*) FROM risk WHERE mean < -0.5) AS sellers, (SELECT count(*) FROM risk) AS types,
  {sr(f'(SELECT {PC} FROM eps ORDER BY {PC} DESC, ticker, episode_id LIMIT 1 OFFSET 4)', P)} AS fifth, {sr('(SELECT arg_min(sharpe_ratio, event_type) FROM risk)', P)} AS first_sharpe, (SELECT strftime(min(start_date), '%Y-%m-%d') FROM eps) AS first_date"""))
def _(spark, sf):
    whole, text = ("total", "buyers", "sellers", "types"), ("first_date",)
    d = ep.ep_report(extracted(spark, sf))
    cols = [F.size(F.from_json(F.get_json_object("report", v), "array<string>")).cast("long").alias(k) if k == "tickers" else
            F.get_json_object("report", v).cast("long" if k in whole else "string" if k in text else "double").alias(k) for k, v in REPORT.items()]
    return shown(d.select(*cols), P)


@query("topk_global", with_("eps", f"SELECT * FROM (SELECT 'top' AS kind, ticker, CAST(episode_id AS BIGINT) AS episode_id, {sr(PC, P)} AS price_change_pct FROM eps ORDER BY {PC} DESC, ticker, episode_id LIMIT 5) UNION ALL "
       f"SELECT 'worst', arg_min(ticker, {PC}), CAST(arg_min(episode_id, {PC}) AS BIGINT), {sr(f'min({PC})', P)} FROM eps"))
def _(spark, sf):
    e = extracted(spark, sf).select("ticker", "episode_id", PC)
    top = ep.top_episodes(e).select(F.lit("top").alias("kind"), "ticker", "episode_id", PC)
    worst = e.groupBy().agg(F.min_by(F.struct("ticker", "episode_id", PC), F.struct(PC, "ticker", "episode_id")).alias("w")).select(F.lit("worst").alias("kind"), "w.*")
    return shown(top.unionByName(worst), P)


@query("x_sequences", with_("x7", """SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CAST(30 AS BIGINT) AS steps, round(s1 + 3.7e-7, 3) + 0.0 AS rsi_sum, round(s2 + 3.7e-7, 3) + 0.0 AS band_sum, round(x_label_buy_soft + 3.7e-10, 6) + 0.0 AS target FROM
  (SELECT *, count(x_rsi_14) OVER w30 AS n1, count(x_pos_in_band) OVER w30 AS n2, sum(x_rsi_14) OVER w30 AS s1, sum(x_pos_in_band) OVER w30 AS s2 FROM x7 WINDOW w30 AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING)) WHERE n1 = 30 AND n2 = 30"""))
def _(spark, sf):
    d = seq_windows(x.x_gauss_labels(x.explorer_core(bars(spark, sf))), ["x_rsi_14", "x_pos_in_band"], 30, "x_label_buy_soft", drop_nulls=True)
    total = lambda k: F.aggregate("window", F.lit(0.0), lambda a, r: a + r[k])
    return shown(d.select("ticker", "date", F.size("window").alias("steps"), total("x_rsi_14").alias("rsi_sum"), total("x_pos_in_band").alias("band_sum"),
                          c("x_label_buy_soft").alias("target")), {"*": 3, "target": 6})


@query("x_dropna_prefix", with_("x5", f"SELECT ticker, strftime(date, '%Y-%m-%d') AS date, {sr('x_bb_mid', P)} AS x_bb_mid, {sr('x_bb_width', P)} AS x_bb_width FROM x5 WHERE x_bb_mid IS NOT NULL AND x_bb_upper IS NOT NULL AND x_bb_lower IS NOT NULL AND x_bb_width IS NOT NULL AND x_bb_width_delta_5 IS NOT NULL"))
def _(spark, sf):
    return shown(dropna_prefix(x.x_bollinger(bars(spark, sf)), ("x_bb_",)).select("ticker", "date", "x_bb_mid", "x_bb_width"), P)


# ---- regimes ----

@query("event_onsets", with_("x5", "SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CAST(CASE WHEN f = 1 AND coalesce(p, 0) <> 1 THEN 1 ELSE 0 END AS BIGINT) AS onset FROM "
       "(SELECT *, x_event_local_vol_spike AS f, lag(x_event_local_vol_spike) OVER (PARTITION BY ticker ORDER BY date) AS p FROM x5)"))
def _(spark, sf):
    return shown(rg.event_onsets(x.explorer_core(bars(spark, sf)), "x_event_local_vol_spike").select("ticker", "date", "onset"))


IDS = "CASE regime_state WHEN 'Accumulation' THEN 0 WHEN 'EarlyUp' THEN 1 WHEN 'Peak' THEN 2 WHEN 'Distribution' THEN 3 ELSE 4 END"


@query("regime_label", with_("regime", f"SELECT ticker, strftime(date, '%Y-%m-%d') AS date, regime_state, CAST({IDS} AS BIGINT) AS regime_state_id FROM regime"))
def _(spark, sf):
    return shown(inp.regimes(spark, sf).select("ticker", "date", "regime_state", "regime_state_id"))


cte("seg0", "regime", "SELECT *, lag(regime_state) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM regime")
cte("seg1", "seg0", "SELECT *, sum(CASE WHEN prev IS NULL OR prev <> regime_state THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS segment FROM seg0")
cte("seg", "seg1", "SELECT ticker, segment, min(regime_state) AS state, min(date) AS start_date, max(date) AS end_date, count(*) AS bars FROM seg1 GROUP BY ticker, segment")


@query("state_segments", with_("seg", "SELECT ticker, CAST(segment AS BIGINT) AS segment, state, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, bars FROM seg"))
def _(spark, sf):
    return shown(rg.state_segments(inp.regimes(spark, sf).select("ticker", "date", "regime_state"), "regime_state"))


@query("regime_transition", with_("seg", f"SELECT m.*, {sr('s.mean_stay')} AS mean_stay FROM (SELECT prev AS from_state, regime_state AS to_state, count(*) AS moves, {sr('count(*) / sum(count(*)) OVER (PARTITION BY prev)')} AS probability FROM seg0 WHERE prev IS NOT NULL GROUP BY 1, 2) m "
       "JOIN (SELECT state AS from_state, avg(bars) AS mean_stay FROM seg GROUP BY 1) s USING (from_state)"))
def _(spark, sf):
    return shown(rg.regime_transition(inp.regimes(spark, sf).select("ticker", "date", "regime_state"), "regime_state"))


@query("year_segments", "SELECT CAST(min(y) AS BIGINT) AS first_year, CAST(max(y) AS BIGINT) AS last_year, count(*) AS years, CASE WHEN min(y) = max(y) THEN CAST(min(y) AS VARCHAR) ELSE concat(min(y), '-', max(y)) END AS slug FROM "
       "(SELECT y, y - row_number() OVER (ORDER BY y) AS g FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) GROUP BY g")
def _(spark, sf):
    y = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    return shown(rg.year_segments(y))


step("sr0", "bars", slope=f"close / {L('close', 3)} - 1", r1=f"close / {L('close')} - 1", chg=f"close - {L('close')}", volume_ratio=Q("volume", R("avg", "volume", 20)))
step("sr1", "sr0", curvature=f"slope - {L('slope')}", volatility=R("stddev_samp", "r1", 10), g="CASE WHEN chg > 0 THEN chg ELSE 0 END", l="CASE WHEN chg < 0 THEN -chg ELSE 0 END")
step("sr2", "sr1", rsi=f"100 - 100 / (1 + {Q(R('avg', 'g', 14), R('avg', 'l', 14))})", **{f"q{int(q * 100)}": R(f"quantile_cont_{int(q * 100)}", "close", 60).replace(f"quantile_cont_{int(q * 100)}(close)", f"quantile_cont(close, {q})") for q in (0.4, 0.45, 0.6, 0.8)})
cte("cuts", "sr2", "SELECT quantile_cont(slope, 0.85) AS s85, quantile_cont(slope, 0.15) AS s15, quantile_cont(curvature, 0.15) AS k15, quantile_cont(coalesce(volatility, 0), 0.5) AS vmed FROM sr2")
cte("sr3", "sr2 cuts", """SELECT ticker, date, close, q40, q45, q60, q80, vmed, coalesce(slope, 0) AS slope, coalesce(curvature, 0) AS curvature, coalesce(volatility, 0) AS volatility, coalesce(volume_ratio, 0) AS volume_ratio, coalesce(rsi, 0) AS rsi,
  CASE WHEN slope > s85 THEN 1 ELSE 0 END AS mb, CASE WHEN curvature < k15 THEN 1 ELSE 0 END AS mr, CASE WHEN volume_ratio > 1.5 THEN 1 ELSE 0 END AS vs, CASE WHEN slope < s15 AND rsi < 35 THEN 1 ELSE 0 END AS bd FROM sr2, cuts""")


@query("regime_label_simple", with_("sr3", """SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CASE WHEN close > q80 AND rsi > 60 AND curvature < 0 THEN 'Peak' WHEN close < q40 AND volatility < vmed AND volume_ratio < 1 THEN 'Accumulation'
  WHEN mb = 1 OR mr = 1 OR (slope > 0 AND rsi > 40 AND rsi < 60) THEN 'EarlyUp' WHEN bd = 1 OR (close < q45 AND rsi < 50) THEN 'LateDown' WHEN close > q60 AND slope < 0 AND rsi < 60 THEN 'Distribution' ELSE 'Accumulation' END AS regime,
  CAST(vs AS BIGINT) AS event_volume_surge, CAST(bd AS BIGINT) AS event_breakdown FROM sr3"""))
def _(spark, sf):
    return shown(rg.regime_label_simple(bars(spark, sf)).select("ticker", "date", "regime", "event_volume_surge", "event_breakdown"))


step("h0", "bars", ret=f"coalesce(close / {L('close')} - 1, 0)", chg=f"close - {L('close')}", v=f"coalesce(last_value(nullif(volume, 0) IGNORE NULLS) OVER wu, 1.0)")
step("h1", "h0", sd=R("stddev_samp", "ret", 20), whole="stddev_samp(ret) OVER (PARTITION BY ticker)",
     rsi=f"coalesce(100 - 100 / (1 + {Q(R('avg', '(CASE WHEN chg > 0 THEN chg WHEN chg <= 0 THEN 0 END)', 14), R('avg', '(CASE WHEN chg < 0 THEN -chg WHEN chg >= 0 THEN 0 END)', 14))}), 50)", vr=f"coalesce({Q('v', R('avg', 'v', 20))}, 1)")
step("h2", "h1", vol="coalesce(sd, whole)", rsi_scaled="(rsi - 50) / 50", volume_change=f"coalesce({Q('vr', L('vr'))} - 1, 0)")
panel_query("hmm_features", rg.hmm_features, "h2", "ret vol rsi_scaled volume_change")


@query("state_argmax", with_("sc", """SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CASE WHEN coalesce(prob, -1) >= coalesce(peak, -1) AND coalesce(prob, -1) >= coalesce(q, -1) THEN 'Accumulation' WHEN coalesce(peak, -1) >= coalesce(q, -1) THEN 'Peak' ELSE 'LateDown' END AS best_state
  FROM (SELECT *, CASE WHEN volume % 4 = 0 THEN NULL ELSE 1 - prob END AS q FROM sc)"""))
def _(spark, sf):
    d = inp.scores(spark, sf).select("ticker", "date", c("prob").alias("state_prob_Accumulation"), c("peak").alias("state_prob_Peak"),
                                     F.when(c("volume") % 4 != 0, 1 - c("prob")).alias("state_prob_LateDown"))
    return shown(rg.state_argmax(d).select("ticker", "date", "best_state"))
