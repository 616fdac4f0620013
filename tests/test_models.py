"""Models that are fitted, kept and applied; the window model; the path from scores to actions."""

import datetime as dt
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_panels import day, make_panel
from tidebar.operators import labels, learn, ordered, splits
from tidebar.operators.features import atr_v1, returns, rsi_v1
from tidebar.operators.learn import Fitted
from tidebar.operators.metrics import roc_auc
from tidebar.operators.regime_block import m002_features
from tidebar.operators.score_path import POLICY_INPUT, ScoreModel, fit_score_model
from tidebar.plans import catalog


@pytest.fixture(scope="module")
def panel(spark):
    return ordered.pinned(make_panel(spark, {"A": 150, "B": 130, "C": 90}))


def test_models_are_saved_and_applied_to_other_rows(spark, panel, tmp_path):
    d = labels.label_cls(rsi_v1(atr_v1(returns(panel))), 1, 0.01)
    names = ["ret_5", "atr14", "rsi14"]
    model = learn.fit_direction(d.where("ticker <> 'C'"), names, "label_1d_cls", trees=5, depth=3)
    model.save(spark, str(tmp_path / "direction"))
    again = Fitted.load(spark, str(tmp_path / "direction"))
    rest = d.where("ticker = 'C'").drop("label_1d_cls", "futret_1")  # no label is needed to score
    a, b = (m.apply(rest).orderBy("date").toPandas() for m in (model, again))
    assert a["direction_prob"].tolist() == b["direction_prob"].tolist() and len(a) == 90
    assert set(a.columns) == {*rest.columns, "direction_prob", "direction_pred"}


def test_every_bar_of_the_window_reaches_the_score(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, 80)
    rows = [("T0", day(i), float(x), int(x > 0)) for i, x in enumerate(base)]
    for k in range(80):  # one series per changed bar
        rows += [(f"S{k:02d}", day(i), float(x) + (50.0 if i == k else 0.0), int(x > 0)) for i, x in enumerate(base)]
    d = spark.createDataFrame(rows, "ticker string, date date, x double, big_move_event int")
    model = learn.fit_event(d, ["x"], n=60)
    last = {r["ticker"]: r["event_prob"] for r in model.apply(d).where(F.col("date") == F.lit(day(79))).collect()}
    moved = [k for k in range(80) if abs(last[f"S{k:02d}"] - last["T0"]) > 1e-12]
    assert moved == list(range(20, 80))  # the 60 bars of the window, bar -45 among them, and no other


def test_window_model_finds_a_planted_pattern(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(20):
        x = rng.normal(0, 0.3, 300)
        event = np.zeros(300, int)
        for i in range(70, 299, 23):
            x[i - 40:i - 38] += 4.0  # a jump 40 bars before
            event[i] = 1
        rows += [(f"T{s:02d}", day(i), float(v), int(e)) for i, (v, e) in enumerate(zip(x, event))]
    d = spark.createDataFrame(rows, "ticker string, date date, x double, big_move_event int")
    out = learn.clf_event(d, ["x"], n=42)
    auc = {r["split"]: r["roc_auc"] for r in roc_auc(out, "big_move_event", "event_prob", ["split"]).collect()}
    assert auc["valid"] > 0.6


def test_bars_to_position_sizes_with_a_kept_model(spark, panel, tmp_path):
    d = ordered.pinned(m002_features(panel))
    early = splits.split_by_date(d).where("split = 'train'").drop("split")
    model = fit_score_model(early, regime_trees=3, trees=3, reg_trees=3, depth=2)
    model.save(spark, str(tmp_path / "model"))
    a, b = (m.actions(d).orderBy("ticker", "date").toPandas() for m in (model, ScoreModel.load(spark, str(tmp_path / "model"))))
    assert len(a) == 370 and set(POLICY_INPUT) <= set(a.columns)
    for k in ("policy_score", "position_size"):
        assert a[k].tolist() == b[k].tolist()
    assert set(a["action"]) <= {"LONG", "SHORT", "FLAT"} and (a["position_size"].abs() <= 1).all() and (a.loc[a.action == "FLAT", "position_size"] == 0).all()
    early_bars = a.groupby("ticker").head(19)
    assert (early_bars["state_prob_Peak"] == 0).all()  # too few bars behind them


def test_regime_probabilities_need_enough_bars(spark):
    rows = [(t, day(i), float(i % 7), "Peak" if i % 2 else "LateDown") for t, n in (("A", 40), ("B", 25), ("C", 5)) for i in range(n)]
    d = spark.createDataFrame(rows, "ticker string, date date, x double, regime_state string")
    got = learn.clf_regime(d, ["x"], lags=(1,), seq_len=20, trees=3, depth=2).toPandas()
    assert got.groupby("ticker").size().to_dict() == {"A": 21, "B": 6, "C": 1}
    assert got[got.ticker == "C"]["state_prob_Peak"].isna().all() and got[got.ticker == "C"]["date"].tolist() == [day(4)]
    probs = got[got.ticker != "C"][[k for k in got.columns if k.startswith("state_prob_")]]
    assert np.allclose(probs.sum(axis=1), 1)
    assert isinstance(got["date"][0], dt.date)


def line_items(spark, path, suppliers=2, weeks=40):
    rows = [(s, s * 1000 + w, 1, 7, 2.0 + w % 3, 100.0 + (w * 7 + s) % 13, dt.datetime(2020, 1, 1) + dt.timedelta(days=7 * w)) for s in range(1, suppliers + 1) for w in range(weeks)]
    kinds = "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, kinds).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_calibrate_computes_its_scores_once(spark, tmp_path, monkeypatch):
    plans, inner = [], learn.calibrate
    monkeypatch.setattr(learn, "calibrate", lambda d, *rest: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or inner(d, *rest))
    got = {r["method"]: (r["rows"], r["in_range"]) for r in catalog.QUERIES["calibrate"](spark, line_items(spark, tmp_path)).collect()}
    assert got == {"isotonic": (80, 80), "sigmoid": (80, 80)}
    assert len(plans) == 2 and not any("l_suppkey" in p or "Aggregate" in p for p in plans)


def test_fitted_rows_are_not_kept(spark, panel):
    kept = lambda: set(glob.glob(ordered.shared_folder(spark).removeprefix("file:") + "/rdd-*"))
    d = ordered.pinned(panel.select("ticker", "date", "close", F.when(F.col("close") > 10, "Peak").otherwise("Base").alias("regime_state")))
    before = kept()
    assert before
    model = learn.fit_regime(d, ["close"], lags=(1,), seq_len=5, trees=2, depth=2)
    assert kept() == before and model.apply(d).count() == 370  # the frame it was fitted on stays
    d = panel.select("close", (F.col("close") > 10).cast("int").alias("label_rebound_bin"), (F.col("close") % 3).alias("ret_5d_pct"), (-F.col("close") % 2).alias("dd_5d_pct"))
    assert learn.fit_heads(d, ["close"], trees=2, reg_trees=2, depth=2).apply(d).count() == 370 and kept() == before
