"""The hidden Markov model against sums over all paths."""

import datetime as dt
from itertools import product

import numpy as np
import pandas as pd
import pytest

from tidebar.operators import hidden_states, learn
from tidebar.operators.hidden_states import HiddenStates, fit_hidden_states

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(11)
    rows = []
    for ticker, n in (("A", 7), ("B", 1), ("C", 4)):
        for i in range(n):
            k = i // 3 % 2
            rows.append((ticker, dt.date(2020, 1, 1) + dt.timedelta(i), float(rng.normal(3 * k, 1)), float(rng.normal(-k, 0.5))))
    rows.append(("C", dt.date(2021, 1, 1), None, 1.0))
    return rows


@pytest.fixture(scope="module")
def frame(spark, panel):
    return spark.createDataFrame(panel, "ticker string, date date, x double, y double").repartition(3)


def brute(model, x):
    """Likelihood, state probabilities and best path of one sequence, over all paths."""
    dens = np.exp(model.log_density((x - model.centre) / model.width))
    k, weights = len(model.start), {}
    for path in product(range(k), repeat=len(x)):
        p = model.start[path[0]] * dens[0, path[0]]
        for t in range(1, len(x)):
            p *= model.step[path[t - 1], path[t]] * dens[t, path[t]]
        weights[path] = p
    total = sum(weights.values())
    probs = np.array([[sum(p for w, p in weights.items() if w[t] == s) / total for s in range(k)] for t in range(len(x))])
    return np.log(total), probs, max(weights, key=weights.get)


def test_states_equal_all_paths(spark, panel, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(hidden_states, "HELD", 3)
    fitted = fit_hidden_states(frame, FEATURES, 2, max_iter=4)
    fitted.save(spark, str(tmp_path / "model"))
    model = HiddenStates.load(spark, str(tmp_path / "model"))
    got = model.transform(frame.withColumnRenamed("y", "y").selectExpr("*", "1 AS state_before")).toPandas().sort_values(["ticker", "date"])
    rows = pd.DataFrame(panel, columns=["ticker", "date", *FEATURES]).dropna()
    assert len(got) == len(rows)
    likelihood = 0.0
    for ticker, own in rows.groupby("ticker"):
        one, probs, path = brute(model, own[FEATURES].to_numpy())
        mine = got[got.ticker == ticker]
        likelihood += one
        np.testing.assert_allclose(np.stack(mine["probs"]), probs, atol=1e-9)
        assert mine["state"].tolist() == list(path)
    # The last likelihood in the history is that before the last update.
    again = fit_hidden_states(frame, FEATURES, 2, max_iter=5)
    assert again.history[-1] == pytest.approx(likelihood, rel=1e-9)


def test_likelihood_never_falls(frame):
    history = fit_hidden_states(frame, FEATURES, 2, max_iter=25, tol=-1.0).history
    assert len(history) == 25 and (np.diff(history) > -1e-6).all()


def test_finds_two_planted_states(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for s in range(12):
        state = 0
        for i in range(150):
            state = state if rng.random() < 0.95 else 1 - state
            truth[f"T{s}", i] = state
            rows.append((f"T{s}", i, float(rng.normal(1.5 - 3 * state, 1)), float(rng.normal(0, 1 + state))))
    d = spark.createDataFrame(rows, "ticker string, date int, x double, y double")
    model = fit_hidden_states(d, FEATURES, 2).ordered_by(0)
    got = {(r["ticker"], r["date"]): r["state"] for r in model.transform(d).collect()}
    assert np.mean([got[k] == v for k, v in truth.items()]) > 0.95
    assert model.step[0, 0] == pytest.approx(0.95, abs=0.03)


def test_cluster_states_of_bars(spark):
    rng = np.random.default_rng(3)
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(i), float(p), float(v)) for t in "AB" for i, (p, v) in enumerate(zip(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 80))), rng.integers(0, 9, 80)))]
    d = learn.regime_cluster(spark.createDataFrame(rows, "ticker string, date date, close double, volume double"), max_iter=10).toPandas()
    assert len(d) == 160 and set(d["cluster_state"]) <= set(learn.CLUSTER_STATES)
    assert np.allclose(d[["prob_up", "prob_flat", "prob_down"]].sum(axis=1), 1)


def test_no_rows_to_fit(frame):
    with pytest.raises(ValueError, match="no rows"):
        fit_hidden_states(frame.limit(0), FEATURES)
