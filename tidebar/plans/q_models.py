"""Queries that fit models. Fitted values have no SQL, so most are checked on their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import c
from ..operators import labels as lab
from ..operators import learn as ml
from ..operators.features import atr_v1, returns, rsi_v1
from ..operators.ordered import drop_unused, pinned
from ..operators.ranking import sample_weights, turnover_rank_dense
from ..operators.regime_block import m002_features
from ..operators.score_path import REGIME_FEATURES, ScoreModel, fit_score_model
from ..operators.splits import split_by_date
from ..sources.lake import new_folder
from . import inputs as inp
from .inputs import bars
from .q_policy import FEATURES, judged, labelled_features
from .registry import cte, query, shown, sr, with_

# Early and late dates of some rows, as SQL: the first four fifths of their distinct dates are for fitting.
SPLIT = "(SELECT date, CASE WHEN row_number() OVER (ORDER BY date) - 1 < floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM (SELECT DISTINCT date FROM {0}))"


def in_unit(x):
    return F.count_if((c(x) >= 0) & (c(x) <= 1))


cte("moves", "lab", "SELECT * FROM lab WHERE label_1d_cls <> 0")


@query("clf_direction", with_("moves", "SELECT split, count(*) AS rows, count(*) FILTER (label_1d_cls = 1) AS ups, count(*) AS in_range, count(*) AS agreeing, strftime(min(date), '%Y-%m-%d') AS first_date "
                              f"FROM moves JOIN {SPLIT.format('moves')} USING (date) GROUP BY split"))
def _(spark, sf):
    d = sample_weights(turnover_rank_dense(labelled_features(spark, sf)))
    scored = ml.clf_direction(d, FEATURES, "label_1d_cls", "weight", trees=20)  # a smaller model than the default, for time
    return shown(scored.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if(c("label") == 1).alias("ups"), in_unit("direction_prob").alias("in_range"),
        F.count_if((c("direction_prob") > 0.5) == (c("direction_pred") == 1)).alias("agreeing"), F.min("date").alias("first_date")))


@query("clf_event", with_("bm", "SELECT split, count(*) AS rows, CAST(sum(big_move_event) AS BIGINT) AS events, count(*) AS in_range, strftime(min(date), '%Y-%m-%d') AS first_date "
                          f"FROM bm JOIN {SPLIT.format('bm')} USING (date) GROUP BY split"))
def _(spark, sf):
    d = lab.label_big_move(rsi_v1(atr_v1(returns(bars(spark, sf)))))
    scored = ml.clf_event(d, ["ret_5", "atr14", "rsi14", "volume"])
    return shown(scored.groupBy("split").agg(F.count("*").alias("rows"), F.sum("big_move_event").alias("events"), in_unit("event_prob").alias("in_range"),
                                             F.min("date").alias("first_date")))


@query("clf_regime", with_("bars", "SELECT ticker, greatest(count(*) - 19, 1) AS rows, greatest(count(*) - 19, 0) AS summing FROM bars GROUP BY ticker"))
def _(spark, sf):
    d = ml.clf_regime(inp.regimes(spark, sf).select("ticker", "date", "regime_state", *REGIME_FEATURES), REGIME_FEATURES)
    total = sum((c(k) for k in d.columns if k.startswith("state_prob_")), F.lit(0.0))
    return shown(d.groupBy("ticker").agg(F.count("*").alias("rows"), F.count_if(F.abs(total - 1) < 1e-9).alias("summing")))


cte("rebounds", "rd", "SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS i, count(*) OVER () AS n FROM rd WHERE ret_5d_pct IS NOT NULL AND dd_5d_pct IS NOT NULL")
cte("newest", "rebounds", "SELECT *, i - last * va AS place FROM (SELECT *, floor((n - tr - va) / va) AS last FROM (SELECT *, floor(n * 0.7::DOUBLE) AS tr, floor(n * 0.1::DOUBLE) AS va FROM rebounds))")


@query("head_rebound", with_("newest", "SELECT CASE WHEN place < tr THEN 'train' ELSE 'valid' END AS role, count(*) AS rows, CAST(sum(label_rebound_bin) AS BIGINT) AS rebounds, count(*) AS in_range, count(*) AS predicted, "
                             f"{sr('avg(ret_5d_pct)', 3)} AS mean_ret FROM newest WHERE place >= 0 AND place < tr + va GROUP BY 1"))
def _(spark, sf):
    d = lab.label_rebound(rsi_v1(atr_v1(returns(bars(spark, sf)))))
    out = ml.head_rebound(d, FEATURES, trees=10, reg_trees=10, depth=5, step=0.1)  # smaller models than the defaults, for time
    return shown(out.groupBy("role").agg(
        F.count("*").alias("rows"), F.sum("label_rebound_bin").alias("rebounds"), in_unit("pred_rebound_prob").alias("in_range"),
        F.count_if(c("pred_expected_ret_pct").isNotNull() & c("pred_expected_dd_pct").isNotNull()).alias("predicted"), F.avg("ret_5d_pct").alias("mean_ret")), 3)


@query("importance", with_("moves", f"SELECT {len(FEATURES)} AS features, 1.0::DOUBLE AS total FROM (SELECT count(*) AS n FROM moves) WHERE n >= 50"))
def _(spark, sf):
    d = ml.importance(labelled_features(spark, sf), FEATURES, "label_1d_cls", trees=20, depth=8)
    return shown(d.agg(F.count("*").alias("features"), F.sum("importance").alias("total")), 6)


@query("calibrate", with_("mb", "SELECT unnest(['isotonic', 'sigmoid']) AS method, rows, rows AS in_range, scores, 0::BIGINT AS falling FROM (SELECT count(*) AS rows, count(DISTINCT prob) AS scores FROM mb)"))
def _(spark, sf):
    d = pinned(judged(spark, sf).select("big_move_event", "prob"))  # both fits read it several times
    drop_unused(spark)
    out, falling, rising = None, F.count_if(c("y") < c("before") - 1e-12), F.count_if(c("y") > c("before") + 1e-12)
    for method in ("isotonic", "sigmoid"):  # the logistic curve may fall, but then everywhere
        r = ml.calibrate(d, "big_move_event", "prob", method)
        points = r.groupBy("prob").agg(F.max("calibrated").alias("y"), F.count("*").alias("n"), in_unit("calibrated").alias("ok"))
        points = points.withColumn("before", F.lag("y").over(Window.orderBy("prob")))  # one row per distinct score
        r = points.agg(F.sum("n").alias("rows"), F.sum("ok").alias("in_range"), F.count("*").alias("scores"), (falling if method == "isotonic" else F.least(falling, rising)).alias("falling")).withColumn("method", F.lit(method))
        out = r if out is None else out.unionByName(r)
    return shown(out)


cte("cal_pts", "mb", "SELECT prob, avg(big_move_event) AS y, count(*) AS n, row_number() OVER (ORDER BY prob) AS i FROM mb GROUP BY prob")
cte("cal_runs", "cal_pts", "SELECT a.i AS lo, b.i AS hi, sum(c.y * c.n) / sum(c.n) AS m FROM cal_pts a JOIN cal_pts b ON b.i >= a.i JOIN cal_pts c ON c.i BETWEEN a.i AND b.i GROUP BY 1, 2")
cte("cal_low", "cal_runs cal_pts", "SELECT lo, i, min(m) AS m FROM cal_runs JOIN cal_pts ON i BETWEEN lo AND hi GROUP BY lo, i")


@query("calibrate_isotonic", with_("cal_low", f"SELECT {sr('prob', 8)} AS prob, n, {sr('max(m)', 8)} AS calibrated FROM cal_low JOIN cal_pts USING (i) GROUP BY i, prob, n"))
def _(spark, sf):
    out = ml.calibrate(judged(spark, sf), "big_move_event", "prob").groupBy("prob").agg(F.count("*").alias("n"), F.max("calibrated").alias("calibrated"))
    return shown(out, 8)


@query("regime_cluster", with_("bars", "SELECT ticker, count(*) AS rows, count(*) AS known, count(*) AS summing, strftime(min(date), '%Y-%m-%d') AS first_date, "
                               "strftime(max(date), '%Y-%m-%d') AS last_date FROM bars GROUP BY ticker HAVING count(*) > 2"))
def _(spark, sf):
    d = ml.regime_cluster(bars(spark, sf))
    probs = [c(k) for k in d.columns if k.startswith("prob_")]
    one = (F.abs(sum(probs, F.lit(0.0)) - 1) < 1e-9) & (F.least(*probs) >= 0)
    out = d.groupBy("ticker").agg(F.count("*").alias("rows"), F.count_if(c("cluster_state").isin(ml.CLUSTER_STATES)).alias("known"), F.count_if(one).alias("summing"),
                                  F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return shown(out.where("rows > 2"))


@query("score_to_action", with_("bars", "SELECT ticker, count(*) AS rows, count(*) AS known, count(*) AS bounded, count(*) AS flat_is_zero, count(*) AS scored FROM bars GROUP BY ticker"))
def _(spark, sf):
    """Models fitted on the early dates, saved, read back, and applied to all bars; the exact part of the outcome per ticker."""
    d = m002_features(bars(spark, sf))
    path = new_folder(spark, "score-model")
    fit_score_model(split_by_date(d).where("split = 'train'"), trees=10, reg_trees=10, depth=5, step=0.1).save(spark, path)
    out = ScoreModel.load(spark, path).actions(d)
    want = c("pred_rebound_prob") * c("pred_expected_ret_pct") / 100 - 0.5 * F.greatest(F.lit(0.0), -c("pred_expected_dd_pct") / 100)
    return shown(out.groupBy("ticker").agg(
        F.count("*").alias("rows"), F.count_if(c("action").isin("LONG", "SHORT", "FLAT")).alias("known"), F.count_if(F.abs("position_size") <= 1).alias("bounded"),
        F.count_if((c("action") != "FLAT") | (c("position_size") == 0)).alias("flat_is_zero"), F.count_if(F.abs(c("policy_score") - want) < 1e-9).alias("scored")))
