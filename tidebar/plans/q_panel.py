"""Queries for labels, splits, scaling, ranking and cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import labels as lab
from ..operators import ranking as rk
from ..operators import splits as sp
from ..operators.features import atr_v1, returns
from ..operators.regimes import STATES
from ..sources.lake import new_folder
from . import inputs as inp
from .inputs import bars
from .registry import cte, panel_query, query, shown, sr, with_
from .sql_panel import F1

KEYS = "ticker, strftime(date, '%Y-%m-%d') AS date"

# ---- labels ----

panel_query("futret_h", lambda d: lab.future_return(lab.future_return(d, 1), 5), "lab", "futret_1 futret_5")
panel_query("label_cls", lambda d: lab.label_cls(lab.label_cls(d, 1, 0.5), 5, 0.5), "lab", "", ints="label_1d_cls label_5d_cls")
cte("rd0", "bars", "SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS c5, min(close) OVER "
    "(PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS worst FROM bars")
cte("rd1", "rd0", "SELECT *, (c5 / close - 1) * 100 AS ret_5d_pct, (worst / close - 1) * 100 AS dd_5d_pct FROM rd0")
cte("rd", "rd1", f"SELECT *, {F1('ret_5d_pct >= 1 AND dd_5d_pct >= -3')} AS label_rebound_bin FROM rd1")
panel_query("ret_dd_h", lab.ret_dd, "rd", "ret_5d_pct dd_5d_pct")
panel_query("label_rebound", lab.label_rebound, "rd", "", ints="label_rebound_bin")
panel_query("label_big_move", lambda d: lab.label_big_move(atr_v1(d)), "bm", "next_range atr_share", ints="big_move_event")

# ---- scaling ----

ZCOLS = ["atr5", "ret_5", "volume"]


@query("zscore_global", with_("v1", f"SELECT {KEYS}, {sr('(v1.atr5 - m1) / s1')} AS atr5, {sr('(ret_5 - m2) / s2')} AS ret_5, {sr('(volume - 25) / 10')} AS volume FROM v1, "
       "(SELECT avg(atr5) AS m1, stddev_samp(atr5) AS s1, avg(ret_5) AS m2, stddev_samp(ret_5) AS s2 FROM v1)"))
def _(spark, sf):
    d = returns(atr_v1(bars(spark, sf))).select("ticker", "date", *ZCOLS)
    out, _ = sp.zscore_global(d, ZCOLS, {"volume": (25.0, 10.0)})
    return shown(out)


@query("scaler_train_only", with_("v1 split", f"SELECT {KEYS}, split, {sr('(atr5 - m1) / s1')} AS atr5, {sr('(volume - m2) / s2')} AS volume FROM v1 JOIN split USING (date), "
       "(SELECT avg(atr5) AS m1, stddev_pop(atr5) AS s1, avg(volume) AS m2, stddev_pop(volume) AS s2 FROM v1 JOIN split USING (date) WHERE split = 'train')"))
def _(spark, sf):
    d = atr_v1(bars(spark, sf)).select("ticker", "date", "atr5", "volume")
    return shown(sp.scaler_train_only(sp.split_by_date(d), ["atr5", "volume"]))


# ---- splits ----

@query("split_by_date", with_("bars split", "SELECT split, count(*) AS rows, count(DISTINCT date) AS dates, strftime(min(date), '%Y-%m-%d') AS first_date, "
                              "strftime(max(date), '%Y-%m-%d') AS last_date FROM bars JOIN split USING (date) GROUP BY split"))
def _(spark, sf):
    d = sp.split_by_date(bars(spark, sf).select("ticker", "date"))
    return shown(d.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"),
                                        F.max("date").alias("last_date")))


cte("efolds", "dates", """SELECT * FROM (SELECT date, fold, CASE WHEN pos < floor(n * (fold + 1) / k) THEN 'train'
  WHEN pos < CASE WHEN fold < k - 1 THEN floor(n * (fold + 2) / k) ELSE n END THEN 'test' END AS role
  FROM (SELECT *, least(3, floor(n / 2)) AS k FROM dates), (SELECT unnest([0, 1, 2]) AS fold) WHERE fold < k) WHERE role IS NOT NULL""")


@query("split_expanding", with_("bars efolds", "SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS rows, strftime(min(date), '%Y-%m-%d') AS first_date, "
                                "strftime(max(date), '%Y-%m-%d') AS last_date FROM bars JOIN efolds USING (date) GROUP BY fold, role"))
def _(spark, sf):
    d = sp.split_expanding(bars(spark, sf).select("ticker", "date"))
    return shown(d.groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")))


cte("walk0", "bars", "SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) - 1 AS i, count(*) OVER () AS n FROM bars")
cte("walk", "walk0", """SELECT ticker, date, i, fold, CASE WHEN i - fold * st < tr THEN 'train' ELSE 'valid' END AS role FROM
  (SELECT *, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS tr, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS va, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS st FROM walk0),
  (SELECT unnest([0, 1, 2, 3, 4]) AS fold) WHERE fold * st + tr + va <= n AND i >= fold * st AND i < fold * st + tr + va""")


@query("split_walk_forward", with_("walk", "SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS rows, CAST(min(i) AS BIGINT) AS first_row, CAST(max(i) AS BIGINT) AS last_row, "
                                   "strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date FROM walk GROUP BY fold, role"))
def _(spark, sf):
    d = sp.split_walk_forward(bars(spark, sf).select("ticker", "date"))
    return shown(d.groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"),
                                               F.min("date").alias("first_date"), F.max("date").alias("last_date")))


@query("split_random_strat", with_("lab", f"SELECT {KEYS}, CAST(label_1d_cls AS BIGINT) AS label_1d_cls, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM "
       "(SELECT *, count(*) OVER (PARTITION BY label_1d_cls) AS n, row_number() OVER (PARTITION BY label_1d_cls ORDER BY md5(concat(ticker, '|', strftime(date, '%Y-%m-%d'), '|42')), ticker, date) AS r FROM lab)"))
def _(spark, sf):
    d = inp.labelled(spark, sf).select("ticker", "date", "label_1d_cls")
    return shown(sp.split_random_strat(d, "label_1d_cls"))


# ---- windows for sequence models ----

SEQ_SQL = with_("lab", """SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CAST(y AS BIGINT) AS label, CAST(len(a) AS BIGINT) AS steps, round(list_sum(a) + 3.7e-7, 3) + 0.0 AS close_sum, CAST(list_sum(v) AS BIGINT) AS volume_sum FROM
  (SELECT ticker, date, label_1d_cls AS y, list(close) OVER w AS a, list(volume) OVER w AS v FROM lab WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)) WHERE len(a) = 20""")


def _window_sums(d):
    total = lambda k: F.aggregate("window", F.lit(0.0), lambda a, r: a + r[k])
    return shown(d.select("ticker", "date", F.col("label_1d_cls").alias("label"), F.size("window").alias("steps"), total("close").alias("close_sum"),
                          total("volume").cast("long").alias("volume_sum")), 3)


@query("seq_windows", SEQ_SQL)
def _(spark, sf):
    return _window_sums(sp.seq_windows(inp.labelled(spark, sf), ["close", "volume"], 20, "label_1d_cls"))


@query("seq_chunks", SEQ_SQL)
def _(spark, sf):
    """The same windows, cut out of stored chunks."""
    path = new_folder(spark, "chunks")
    sp.seq_chunks(inp.labelled(spark, sf), ["close", "volume"], 20, "label_1d_cls", size=64).write.parquet(path)
    return _window_sums(sp.chunk_windows(spark.read.parquet(path), ["close", "volume"], 20, "label_1d_cls"))


@query("oversample_balance", with_("lab", f"""SELECT {KEYS}, CAST(y AS BIGINT) AS label_1d_cls, CAST(unnest(generate_series(1, copies)) AS BIGINT) AS copy FROM
  (SELECT *, CAST(floor(top / n) AS BIGINT) + CASE WHEN r < top % n THEN 1 ELSE 0 END AS copies FROM
  (SELECT *, max(n) OVER () AS top FROM (SELECT ticker, date, label_1d_cls AS y, count(*) OVER (PARTITION BY label_1d_cls) AS n,
  row_number() OVER (PARTITION BY label_1d_cls ORDER BY ticker, date) - 1 AS r FROM lab)))"""))
def _(spark, sf):
    d = inp.labelled(spark, sf).select("ticker", "date", "label_1d_cls")
    return shown(sp.oversample_balance(d, "label_1d_cls", ["ticker", "date"]))


@query("k_threshold_cv", with_("bm efolds", f"""SELECT k, folds, {sr('score')} AS score, CASE WHEN row_number() OVER (ORDER BY score DESC, k) = 1 THEN 1 ELSE 0 END AS best FROM
  (SELECT k, count(*) AS folds, avg(CASE WHEN r > 0 AND r < n AND p > 0 THEN CAST(tp AS DOUBLE) / p * tp / r ELSE 0 END) AS score FROM
  (SELECT k, fold, count(*) AS n, count(*) FILTER (hit) AS p, count(*) FILTER (ev) AS r, count(*) FILTER (hit AND ev) AS tp FROM
  (SELECT k, fold, next_range >= k * share AS hit, next_range >= k * atr_share AS ev FROM bm JOIN efolds USING (date)
   JOIN (SELECT fold, avg(atr14) / avg(close) AS share FROM bm JOIN efolds USING (date) WHERE role = 'train' GROUP BY fold) s USING (fold),
   (SELECT unnest([0.8, 1.0, 1.2, 1.5]::DOUBLE[]) AS k) WHERE role = 'test' AND next_range IS NOT NULL) GROUP BY ALL) GROUP BY k)""").replace("AS best FROM", "AS best FROM"))
def _(spark, sf):
    return shown(sp.big_move_grid(inp.big_moves(spark, sf)))


# ---- ranking ----

@query("turnover_rank_dense", with_("bars", f"""SELECT {KEYS}, CAST(r AS BIGINT) AS turnover_rank_today, CAST(coalesce(p, -1) AS BIGINT) AS turnover_rank_prev1, {sr('ratio')} AS turnover_ratio_1d,
  CAST(coalesce(CAST(p <= 5 AS INT), -1) AS BIGINT) AS is_top5_prev1 FROM (SELECT *, lag(r) OVER (PARTITION BY ticker ORDER BY date) AS p, turnover / lag(turnover) OVER (PARTITION BY ticker ORDER BY date) AS ratio
  FROM (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY turnover DESC) AS r FROM bars))"""))
def _(spark, sf):
    d = rk.turnover_rank_dense(bars(spark, sf).select("ticker", "date", "turnover"))
    prev = F.col("turnover_rank_prev1")
    return shown(d.select("ticker", "date", "turnover_rank_today", F.coalesce(prev, F.lit(-1)).alias("turnover_rank_prev1"), "turnover_ratio_1d",
                          F.coalesce((prev <= 5).cast("int"), F.lit(-1)).alias("is_top5_prev1")))


cte("ranks", "bars dates", """SELECT b.*, coalesce(CASE WHEN prev_t <> 0 THEN turnover / prev_t - 1 END, 0) AS turnover_ratio_1d, coalesce(r.rank, 9999) AS turnover_rank_prev1 FROM
  (SELECT *, lag(turnover) OVER (PARTITION BY ticker ORDER BY date) AS prev_t FROM bars) b LEFT JOIN
  (SELECT ticker, nd.date AS date, CAST(floor(rank() OVER (PARTITION BY b.date ORDER BY turnover DESC) + (count(*) OVER (PARTITION BY b.date, turnover) - 1) / 2) AS BIGINT) AS rank
   FROM bars b JOIN dates d ON d.date = b.date JOIN dates nd ON nd.pos = d.pos + 1) r ON r.ticker = b.ticker AND r.date = b.date""")


def ranked(spark, sf):
    return rk.turnover_rank_avg(bars(spark, sf).select("ticker", "date", "turnover", "close", "volume"))


RANK_SQL = with_("ranks", f"SELECT {KEYS}, CAST(turnover_rank_prev1 AS BIGINT) AS turnover_rank_prev1, {sr('turnover_ratio_1d')} AS turnover_ratio_1d FROM ranks")


@query("turnover_rank_avg", RANK_SQL)
def _(spark, sf):
    return shown(ranked(spark, sf).select("ticker", "date", "turnover_rank_prev1", "turnover_ratio_1d"))


@query("join_left_rank", with_("ranks", f"SELECT {KEYS}, CAST(turnover_rank_prev1 = 9999 AS BIGINT) AS missing, CAST(turnover_rank_prev1 AS BIGINT) AS turnover_rank_prev1 FROM ranks"))
def _(spark, sf):
    return shown(ranked(spark, sf).select("ticker", "date", (F.col("turnover_rank_prev1") == 9999).alias("missing"), "turnover_rank_prev1"))


@query("liquidity_weights", with_("ranks bm", f"""SELECT r.ticker, strftime(r.date, '%Y-%m-%d') AS date, CAST(big_move_event AS BIGINT) AS big_move_event,
  round(CASE WHEN turnover_rank_prev1 BETWEEN 1 AND 100 THEN 2.0 WHEN turnover_rank_prev1 BETWEEN 101 AND 300 THEN 1.5 WHEN turnover_rank_prev1 BETWEEN 301 AND 1000 THEN 1.2 ELSE 1.0 END::DOUBLE
  / count(*) OVER (PARTITION BY big_move_event), 10) AS weight FROM ranks r JOIN bm USING (ticker, date)"""))
def _(spark, sf):
    d = ranked(spark, sf).select("ticker", "date", "turnover_rank_prev1").join(inp.big_moves(spark, sf).select("ticker", "date", "big_move_event"), ["ticker", "date"])
    return shown(rk.liquidity_weights(d, "big_move_event").drop("turnover_rank_prev1"), 10)


@query("sample_weights", with_("bars", """SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CAST(CASE WHEN p <= 100 THEN 3.0 WHEN p <= 300 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS weight FROM
  (SELECT *, lag(r) OVER (PARTITION BY ticker ORDER BY date) AS p FROM (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY turnover DESC) AS r FROM bars))"""))
def _(spark, sf):
    d = rk.turnover_rank_dense(bars(spark, sf).select("ticker", "date", "turnover"))
    return shown(rk.sample_weights(d).select("ticker", "date", "weight"))


STATE_LIST = ", ".join(f"'{s}'" for s in STATES)
cte("regime", "m002", """SELECT *, CASE
  WHEN event_exhaustion_candidate = 1 OR I_bd_early = 1 OR (pos_in_band_rel > 0.8 AND rsi_smooth > 55 AND delta_rsi < 0.5) THEN 'Peak'
  WHEN pos_in_band_rel < 0.4 AND atr_rel < 1.2 AND volume_z < 1.0 THEN 'Accumulation'
  WHEN event_volume_regain = 1 OR event_rebound_candidate = 1 OR (ema_spread_rel > -0.05 AND price_slope > -0.01 AND rsi_smooth > 40) THEN 'EarlyUp'
  WHEN I_bd_late = 1 OR (event_rebound_candidate = 1 AND curv_2 > -0.5 AND ema_spread_rel > -0.5 AND price_slope < 0.1) OR (pos_in_band_rel < 0.45 AND rsi_smooth < 50 AND delta_rsi < 0) THEN 'LateDown'
  WHEN event_breakdown_risk = 1 OR (pos_in_band_rel > 0.55 AND price_slope < 0 AND rsi_smooth < 60) THEN 'Distribution'
  ELSE 'Accumulation' END AS regime_state FROM m002""")


@query("class_weights", with_("regime", f"""SELECT regime_state, CAST(n AS BIGINT) AS n, round(raw / avg(raw) OVER () + 3.7e-10, 6) AS weight FROM (SELECT regime_state, n, sqrt(sum(n) OVER () / n) AS raw FROM
  (SELECT regime_state, coalesce(n, min(n) OVER ()) AS n FROM (SELECT unnest([{STATE_LIST}]) AS regime_state) LEFT JOIN (SELECT regime_state, count(*) AS n FROM regime GROUP BY 1) USING (regime_state)))"""))
def _(spark, sf):
    return shown(sp.class_weights(inp.regimes(spark, sf), "regime_state", STATES))


@query("topn_per_date", with_("sc", f"SELECT {KEYS}, {sr('prob')} AS prob, CAST(r AS BIGINT) AS score_rank FROM (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY prob DESC) AS r FROM sc) WHERE r <= 5"))
def _(spark, sf):
    return shown(rk.topn_per_date(inp.scores(spark, sf), "prob", 5).select("ticker", "date", "prob", "score_rank"))


@query("daily_topk_precision", with_("bm sc", f"""SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS picked, CAST(sum(big_move_event) AS BIGINT) AS hits, {sr('avg(big_move_event)')} AS "precision" FROM
  (SELECT bm.date, big_move_event, row_number() OVER (PARTITION BY bm.date ORDER BY prob DESC, bm.ticker) AS r FROM bm JOIN sc USING (ticker, date)) WHERE r <= 5 GROUP BY date"""))
def _(spark, sf):
    d = lab.label_big_move(atr_v1(inp.scores(spark, sf)))
    return shown(rk.daily_topk_precision(d, "prob", "big_move_event", 5))


# ---- dense grid ----

@query("cross_grid", with_("preds", """SELECT d.date AS date, t.ticker, CAST(coalesce(s, 0) AS BIGINT) AS signal FROM (SELECT DISTINCT strftime(date, '%Y-%m-%d') AS date FROM bars) d, (SELECT DISTINCT ticker FROM bars) t
  LEFT JOIN (SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CASE action WHEN 'LONG' THEN 1 ELSE -1 END AS s FROM preds WHERE action <> 'FLAT') p ON p.ticker = t.ticker AND p.date = d.date"""))
def _(spark, sf):
    from ..operators.trades import signal_grid

    s = inp.scores(spark, sf)
    p = F.col("prob")
    sig = s.select("ticker", "date", F.when(p >= 0.6, 1).when(p <= 0.2, -1).alias("signal")).where(F.col("signal").isNotNull())
    return shown(signal_grid(s, sig))


@query("price_matrix", with_("bars", """SELECT d.date AS date, t.ticker, round(last_value(close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING), 8) AS close
  FROM (SELECT DISTINCT strftime(date, '%Y-%m-%d') AS date FROM bars) d, (SELECT DISTINCT ticker FROM bars) t
  LEFT JOIN (SELECT ticker, strftime(date, '%Y-%m-%d') AS date, close FROM bars) p ON p.ticker = t.ticker AND p.date = d.date"""))
def _(spark, sf):
    from ..operators.trades import price_grid

    return shown(price_grid(bars(spark, sf)), 8)
