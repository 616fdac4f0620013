"""Operators on small hand-made panels, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import analytics, clean, episodes, explorer, features, labels, learn, metrics, ordered, panel, policy, ranking, regime_block, regimes, splits, trades
from tidebar.operators.ewm import ewm
from tidebar.sources import lake

DAY0 = dt.date(2020, 1, 6)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def make_panel(spark, sizes, seed=1, gaps=False):
    rnd = random.Random(seed)
    rows = []
    for name, n in sizes.items():
        px = 100.0
        for i in range(n):
            px *= math.exp(rnd.gauss(0, 0.05))
            o = px * math.exp(rnd.gauss(0, 0.01))
            hi, lo = max(px, o) * (1 + rnd.random() * 0.02), min(px, o) * (1 - rnd.random() * 0.02)
            v = None if gaps and rnd.random() < 0.1 else float(rnd.randint(0 if gaps else 1, 1000))
            rows.append((name, day(i), o, hi, lo, px, v, px * (v or 0)))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, turnover double")


def local(df):
    return df.orderBy("ticker", "date").toPandas()


@pytest.mark.parametrize("block", [None, 7])
def test_ewm_matches_recursion(spark, block):
    df = make_panel(spark, {"A": 61, "B": 3, "C": 1})
    df = df.withColumn("late", F.when(F.col("date") >= F.lit(day(4)), F.col("close")))
    got = local(ewm(df, {"fast": ("close", 0.5), "slow": ("close", 2 / 51), "held": ("late", 1 / 14)}, {"held": 14}, block))
    for _, g in got.groupby("ticker"):
        assert np.allclose(g["fast"], g["close"].ewm(alpha=0.5, adjust=False).mean(), rtol=1e-12)
        assert np.allclose(g["slow"], g["close"].ewm(alpha=2 / 51, adjust=False).mean(), rtol=1e-12)
        want = g["late"].ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        assert np.allclose(g["held"].astype(float), want, equal_nan=True, rtol=1e-12)


def test_ewm_across_many_default_blocks(spark):
    df = make_panel(spark, {"A": 1300})
    got = local(ewm(df, {"slow": ("close", 2 / 51), "fast": ("close", 0.5)}))
    assert np.allclose(got["slow"], got["close"].ewm(alpha=2 / 51, adjust=False).mean(), rtol=1e-10)
    assert np.allclose(got["fast"], got["close"].ewm(alpha=0.5, adjust=False).mean(), rtol=1e-10)


def test_warm_up_and_fallbacks(spark):
    got = local(features.core_features(make_panel(spark, {"A": 20})))
    tr = pd.concat([got.high - got.low, (got.high - got.close.shift()).abs(), (got.low - got.close.shift()).abs()], axis=1).max(axis=1)
    assert np.allclose(got.atr5[:4], tr[:4]) and np.allclose(got.atr5[4:], tr.rolling(5).mean()[4:])
    assert got.atr10[:4].isna().all() and np.allclose(got.atr10[4:9], tr.rolling(5).mean()[4:9])
    assert got.atr14[:9].isna().all() and np.allclose(got.atr14[9:13], tr.rolling(10).mean()[9:13])


def test_flat_prices_stay_finite(spark):
    rows = [("A", day(i), 5.0, 5.0, 5.0, 5.0, 10.0, 50.0) for i in range(70)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, turnover double")
    got = local(features.add_feature_set(df, "m002"))
    assert np.isfinite(got["stochk14"]).all() and (got["stochk14"] == 0).all() and (got["rel_range"] == 0).all()
    x = local(explorer.x_minmax(df))
    assert (x["x_close_scaled"] == 0.5).all()


def test_other_tickers_and_later_bars_do_not_matter(spark):
    df = make_panel(spark, {"A": 80, "B": 80})
    cols = ["ticker", "date", "rsi_smooth", "curv_2", "macd_hist", "event_breakdown_risk"]
    both = local(features.add_feature_set(df, "m002").select(*cols))
    alone = local(features.add_feature_set(df.where("ticker = 'A'"), "m002").select(*cols))
    assert both[both.ticker == "A"].reset_index(drop=True).equals(alone)
    early = local(features.add_feature_set(df.where((F.col("ticker") == "A") & (F.col("date") < F.lit(day(60)))), "m002").select(*cols))
    a, b = alone.iloc[:60].drop(columns=["ticker", "date"]).astype(float), early.drop(columns=["ticker", "date"]).astype(float)
    assert np.allclose(a, b, equal_nan=True, rtol=1e-12)


def test_curvature_matches_least_squares(spark):
    df = make_panel(spark, {"A": 40})
    df = df.withColumn("x", F.when(F.dayofmonth("date") % 4 != 0, F.col("close")))
    got = local(regime_block.curv_2(df, "x"))
    for i in range(len(got)):
        y = got["x"].iloc[max(0, i - 10):i + 1].dropna().to_numpy(float)
        if len(y) < 5:
            assert pd.isna(got["curv_2"].iloc[i])
        else:
            t = np.arange(len(y))
            want = np.polyval(np.polyder(np.polyfit(t, y, 3), 2), t[len(y) // 2])
            assert abs(got["curv_2"].iloc[i] - want) < 1e-8


def test_unknown_feature_set(spark):
    with pytest.raises(ValueError):
        features.add_feature_set(make_panel(spark, {"A": 3}), "v9")


def test_episodes_match_the_direct_loop(spark):
    rnd = random.Random(5)
    names = ["x_e1", "x_e2"]
    rows = [(t, day(i), int(rnd.random() < 0.06), int(rnd.random() < 0.08)) for t in ("A", "B") for i in range(90)]
    df = spark.createDataFrame(rows, "ticker string, date date, x_e1 int, x_e2 int")
    got = local(episodes.episode_assign(df, names))
    for _, g in got.groupby("ticker"):
        ids, labs, nxt = [-1] * len(g), [""] * len(g), 0
        for e in names:
            for i in np.flatnonzero(g[e].to_numpy()):
                for p in range(max(0, i - 5), min(len(g) - 1, i + 5) + 1):
                    if ids[p] == -1:
                        ids[p], labs[p] = nxt, f"{e[2:]}:{nxt}"
                nxt += 1
        assert g["episode_id"].tolist() == ids and g["episode_label"].tolist() == labs


def test_ranks_with_ties_nulls_and_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [(day(0), f"T{i:04d}", float(rnd.randint(0, 50)) if rnd.random() > 0.05 else None) for i in range(2000)]
    rows += [(day(d), f"T{i}", float(i % 3)) for d in range(1, 30) for i in range(5)]
    df = spark.createDataFrame(rows, "date date, ticker string, v double")
    got = ordered.add_ranks(df, ["date"], "v").toPandas()
    g = got.groupby("date")["v"]
    for col, method in (("dense_rank", "dense"), ("first_rank", "min"), ("average_rank", "average")):
        want = g.rank(method=method, ascending=False)
        assert np.allclose(got[col].astype(float), want, equal_nan=True), col
    q = ordered.exact_quantiles(df, ["date"], "v", {"a": 0.2, "b": 0.8}).toPandas().set_index("date")
    want = g.quantile([0.2, 0.8]).unstack()
    assert np.allclose(q.loc[want.index, ["a", "b"]], want)


def test_row_index_is_a_total_order(spark):
    df = make_panel(spark, {f"T{i}": 50 for i in range(20)}).select("date", "ticker")
    got = splits.row_index(df, ["date", "ticker"]).toPandas().sort_values(["date", "ticker"])
    assert got["row_idx"].tolist() == list(range(1000)) and (got["n_rows"] == 1000).all()


def test_walk_forward_falls_back_to_one_split(spark):
    df = make_panel(spark, {"A": 10}).select("date", "ticker")
    got = splits.split_walk_forward(df, train=0.95, valid=0.2).groupBy("fold", "role").count().toPandas()
    assert {(r.fold, r.role): r["count"] for _, r in got.iterrows()} == {(0, "train"): 8, (0, "valid"): 2}


@pytest.mark.parametrize("small,accuracy", [(10_000, 10_000), (50, 100), (0, 1000)])
def test_quantiles_from_brackets_are_exact(spark, monkeypatch, small, accuracy):
    monkeypatch.setattr(ordered, "SMALL_GROUP", small)
    monkeypatch.setattr(ordered, "ACCURACY", accuracy)
    rng = np.random.default_rng(6)
    rows = [("wide", float(x)) for x in rng.normal(0, 1, 4000)] + [("tied", 0.0)] * 3000 + [("tied", float(x)) for x in rng.integers(-2, 3, 2500)]
    rows += [("few", float(x)) for x in range(7)] * (1 if small else 300) + [("none", None)] + [("skew", float(np.exp(5 * x))) for x in rng.normal(0, 1, 1500)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.2, "c": 0.425, "d": 0.45, "e": 0.8, "f": 1.0}
    got = ordered.exact_quantiles(d, ["g"], "v", probs).toPandas().set_index("g")
    known = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    assert sorted(got.index) == sorted(set(known.g))
    for g, own in known.groupby("g"):
        np.testing.assert_allclose(got.loc[g].to_numpy(float), np.quantile(own.v, list(probs.values())), rtol=1e-12)
    whole = ordered.exact_quantiles(d, [], "v", probs).first()
    np.testing.assert_allclose(list(whole), np.quantile(known.v, list(probs.values())), rtol=1e-12)
    assert ordered.exact_quantiles(d.where("v > 1e9"), ["g"], "v", probs).count() == 0


def test_ranks_of_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    monkeypatch.setattr(ordered, "HOT_VALUES", 2)
    rng = np.random.default_rng(7)
    rows = [(i, "d1", 5.0) for i in range(2000)] + [(i, "d1", float(x)) for i, x in enumerate(rng.integers(0, 12, 300))] + [(i, "d2", float(i % 3)) for i in range(600)] + [(9, "d2", None)]
    d = spark.createDataFrame(rows, "i long, date string, v double").repartition(4)
    got = ordered.add_ranks(d, ["date"], "v").toPandas()
    assert len(got) == len(rows)
    for kind, method in (("dense_rank", "dense"), ("first_rank", "min"), ("average_rank", "average")):
        want = got.groupby("date")["v"].rank(method=method, ascending=False)
        assert (got[kind].fillna(-1) == want.fillna(-1)).all()


def test_correlations_of_a_wide_frame(spark):
    rng = np.random.default_rng(9)
    n, k = 300, 60
    x = 1e6 + rng.normal(0, 1, (n, 1)) * rng.normal(0, 1, k) + rng.normal(0, 1, (n, k))
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:, 7], x[:, 8] = 3.0, np.nan
    names = [f"f{i}" for i in range(k)]
    frame = pd.DataFrame(x, columns=names)
    d = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in analytics.corr_matrix(d, names, rows_out=100).collect()}
    want = frame.corr()
    assert len(got) == k * (k - 1) // 2
    for (a, b), r in got.items():
        assert r is None if {a, b} & {"f7", "f8"} else r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_panel_joins_and_lists(spark):
    base = spark.createDataFrame([("A", day(0)), ("A", day(1)), ("B", day(0)), (None, day(0))], "ticker string, date date")
    preds = spark.createDataFrame([("A", day(1), 0.7, "LONG"), ("C", day(0), 0.1, "SHORT")], "ticker string, date date, prob double, action string")
    got = {(r["ticker"], r["date"]): (r["prob"], r["action"]) for r in panel.join_panels(base, preds, fill={"prob": 0.0, "action": "FLAT"}).collect()}
    assert got == {("A", day(0)): (0.0, "FLAT"), ("A", day(1)): (0.7, "LONG"), ("B", day(0)): (0.0, "FLAT"), (None, day(0)): (0.0, "FLAT")}
    listed = spark.createDataFrame([("A", 1), ("A", 2), (None, 3)], "ticker string, x int")
    assert panel.in_list(base, listed).count() == 2 and panel.in_list(base, listed, inside=False).count() == 2
    sectors = panel.sector_table(spark, {"tech": ["a ", "B"], "old": ["b", "b"]})
    both = panel.join_sectors(base, sectors).groupBy("sector").count().collect()
    assert {r["sector"]: r["count"] for r in both} == {"tech": 3, "old": 1}
    assert panel.join_sectors(base.limit(0), sectors).count() == 0


def test_panel_summaries(spark):
    rows = [("A", day(0), 1.0, 2.0, 1), ("B", day(0), 3.0, 2.0, 0), ("A", day(1), 1.0, 3.0, -1), ("B", day(1), 1.0, 2.0, 1), ("C", day(1), 5.0, None, None)]
    d = spark.createDataFrame(rows, "ticker string, date date, open double, close double, y int")
    rates = {r["date"]: (r["any"], r["up"]) for r in panel.class_rates(d, "y", {"any": None, "up": 1}).collect()}
    assert rates == {day(0): (0.5, 0.5), day(1): (1.0, 0.5)}  # a row without a label has no say
    assert {r["ticker"]: (r["close_count"], r["close_max"]) for r in panel.summary(d, {"close": ["count", "max"]}).collect()} == {"A": (2, 3.0), "B": (2, 2.0), "C": (0, None)}
    assert {r["y"]: r["n"] for r in panel.value_share(d, "y").collect()} == {1: 2, 0: 1, -1: 1, None: 1}
    assert {r["ticker"]: r["share"] for r in panel.rising_share(d).collect()} == {"A": 1.0, "B": 0.5}
    assert {r["date"]: (r["state_a"], r["same"]) for r in panel.state_agreement(d, d.where("ticker <> 'A'")).collect()} == {day(0): ("DOWN", True), day(1): ("UP", False)}
    assert panel.distinct_values(d).count() == 5


@pytest.mark.parametrize("seq_len,size", [(5, 8), (5, 1), (1, 3), (20, 512)])
def test_windows_cut_out_of_chunks(spark, seq_len, size):
    d = make_panel(spark, {"A": 61, "B": 4, "C": 1, "D": 16}, gaps=True).withColumn("y", F.col("close") > F.col("open"))
    names = ["close", "volume"]
    chunks = splits.seq_chunks(d, names, seq_len, "y", size)
    stored = sum(len(r["bars"]) for r in chunks.collect())
    assert stored < 2 * d.count()
    for drop in (False, True):
        a, b = (sorted(map(repr, x.collect())) for x in (splits.seq_windows(d, names, seq_len, "y", drop), splits.chunk_windows(chunks, names, seq_len, "y", drop)))
        assert a == b
    assert splits.chunk_windows(splits.seq_chunks(d.limit(0), names, seq_len), names, seq_len).count() == 0


def test_oversample_reaches_the_largest_class(spark):
    rows = [("A", day(i), 0 if i < 37 else (1 if i < 47 else 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "ticker string, date date, y int")
    got = splits.oversample_balance(df, "y", ["ticker", "date"], chunk=4)
    n = got.groupBy("y").count().toPandas().set_index("y")["count"].to_dict()
    assert n == {0: 37, 1: 37, 2: 37}
    per = got.where("y = 2").groupBy("date").count().orderBy("date").toPandas()["count"].tolist()
    assert per == [13, 12, 12]


def test_keep_last_with_many_copies(spark):
    df = spark.range(5000).select(F.lit("US").alias("market"), F.lit("A").alias("ticker"), F.lit(day(0)).alias("date"), F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    got = clean.keep_last(df, ["market", "ticker", "date"], ["seq"]).collect()
    assert len(got) == 1 and got[0]["v"] == 9998


def test_trades_start_end_and_never(spark):
    sig = {"A": [1, 1, 0, 0, 1], "B": [0, 0, 0, 0, 0], "C": [0, 1, 0, 1, 0]}
    px = {"A": [10, 11, 12, 13, 14], "B": [1] * 5, "C": [5, 4, 8, 2, 1]}
    rows = [(t, day(i), float(px[t][i]), s) for t, v in sig.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, signal int")
    got = {(r["ticker"], r["trade"]): r for r in trades.trades_long_flat(df, fee=0.0).collect()}
    assert set(got) == {("A", 1), ("A", 2), ("C", 1), ("C", 2)}
    assert got["A", 1]["return"] == pytest.approx(0.2) and got["A", 1]["bars"] == 2 and got["A", 1]["open"] == 0
    assert got["A", 2]["open"] == 1 and got["A", 2]["return"] == pytest.approx(0.0)
    assert got["C", 1]["win"] == 1 and got["C", 2]["win"] == 0
    eq = trades.equity_curve(df, fee=0.0).where("ticker = 'C'").orderBy("date").toPandas()["equity"].tolist()
    assert eq == pytest.approx([10000, 10000, 20000, 20000, 10000])
    stats = {r["ticker"]: r for r in trades.perf_stats(df).collect()}
    assert stats["B"]["trades"] == 0 and stats["B"]["equity_final"] == pytest.approx(10000)


def test_auc_against_pairs(spark):
    rnd = random.Random(8)
    rows = [(float(rnd.randint(0, 20)) / 20, int(rnd.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, y int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, "y", "p").first()["roc_auc"] == pytest.approx(want)
    chosen = metrics.threshold_curve(df, "y", "p", 0.99).where("chosen = 1").first()
    prec = {t: (sum(y for p, y in rows if p >= t / 100) / max(1, sum(p >= t / 100 for p, _ in rows))) for t in range(1, 100)}
    assert chosen["precision"] == pytest.approx(max(prec.values()))


def test_policy_quantiles_and_action(spark):
    df = make_panel(spark, {"A": 90, "B": 90})
    d = df.select("ticker", "date", (F.col("volume") / 1000).alias("policy_score"), F.lit(0.0).alias("atr_smooth"), F.lit(0).alias("I_vr_and_vs"), F.lit(0).alias("I_bd_early"),
                  F.lit(0).alias("I_bd_late"), F.lit(0.2).alias("state_prob_Peak"), F.lit(1.0).alias("pred_expected_ret_pct"))
    got = policy.apply_policy(d).toPandas()
    assert got["long_q"].iloc[0] == pytest.approx(np.quantile(got["effective_score"], 0.45))
    assert (got["ex_ante_vol"] == 0.15).all()
    tradable = got["effective_score"].abs() >= 0.1
    assert (got.loc[tradable & (got["effective_score"] >= got["long_q"]), "action"] == "LONG").all()
    assert (got.loc[got["action"] == "FLAT", "position_size"] == 0).all() and got["position_size"].abs().max() <= 1
    grid = policy.policy_grid(d).toPandas()
    assert len(grid) == 35 and grid["best"].sum() == 1


def test_top_n_keeps_ties(spark):
    rows = [(day(0), t, v) for t, v in zip("ABCDE", (3.0, 3.0, 2.0, 1.0, 1.0))]
    df = spark.createDataFrame(rows, "date date, ticker string, s double")
    assert sorted(r["ticker"] for r in ranking.topn_per_date(df, "s", 2).collect()) == ["A", "B", "C"]


def test_previous_market_date_rank(spark):
    rows = [("A", day(0), 5.0), ("B", day(0), 5.0), ("A", day(1), 1.0), ("A", day(2), 1.0), ("B", day(2), 9.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, turnover double")
    got = {(r["ticker"], r["date"]): r["turnover_rank_prev1"] for r in ranking.turnover_rank_avg(df).collect()}
    assert got["A", day(1)] == 1 and got["A", day(2)] == 1  # average rank 1.5 is cut to 1
    assert got["B", day(2)] == 9999 and got["A", day(0)] == 9999


def test_labels_at_the_tail(spark):
    df = make_panel(spark, {"A": 6})
    got = local(labels.label_rebound(labels.label_cls(df, 5, 0.01)))
    assert got["futret_5"].isna().tolist() == [False] + [True] * 5 and (got["label_5d_cls"][1:] == 0).all()
    assert got["dd_5d_pct"].iloc[-1] == pytest.approx(0.0) and (got["label_rebound_bin"][1:] == 0).all()


def test_ingest_file_tree(spark, tmp_path):
    kr, us = tmp_path / "kr", tmp_path / "us"
    for p in (kr, us / "nasdaq" / "csv", us / "nyse" / "csv" / "more"):
        p.mkdir(parents=True)
    (kr / "005930.csv").write_text("date,open,high,low,close,volume,value\n20200102,\"1,000\",1100,900,1050,10,10500\n20200103,,,,1060,11,\nbad,1,1,1,1,1,1\n")
    (kr / "readme.csv").write_text("date,open,high,low,close,volume,value\n20200102,1,1,1,1,1,1\n")
    us_head = "Date,Low,Open,Volume,High,Close,Adjusted Close\n"
    (us / "nasdaq" / "csv" / "abc.csv").write_text(us_head + "02-01-2020,9,10,100,12,11,10.5\n")
    (us / "nyse" / "csv" / "more" / "abc.csv").write_text(us_head + "02-01-2020,9,10,999,12,11,10.5\n")
    # another column order, a name with characters that paths escape, a short line and a long one
    (us / "nyse" / "csv" / " B^F+1 %.csv").write_text("Date,Open,High,Low,Close,Volume,Adjusted Close\n02-01-2020,1,4,0.5,2,300,2\n03-01-2020,1,4,0.5,2\n04-01-2020,1,4,0.5,2,300,2,9,9\n")
    got = {(r["market"], r["ticker"], r["date"]): r for r in lake.ingest_tree(spark, str(kr), str(us)).collect()}
    assert set(got) == {("KR", "005930", dt.date(2020, 1, 2)), ("KR", "005930", dt.date(2020, 1, 3)), ("US", "ABC", dt.date(2020, 1, 2)),
                        *[("US", "B^F+1 %", dt.date(2020, 1, k)) for k in (2, 3, 4)]}
    odd = got["US", "B^F+1 %", dt.date(2020, 1, 2)]
    assert (odd["open"], odd["high"], odd["low"], odd["close"], odd["volume"], odd["exchange"]) == (1.0, 4.0, 0.5, 2.0, 300, "NYSE")
    assert got["US", "B^F+1 %", dt.date(2020, 1, 3)]["close"] == 2.0 and got["US", "B^F+1 %", dt.date(2020, 1, 3)]["volume"] is None
    counts = {r["_path"].rsplit("/", 1)[1]: (r["lines"], r["malformed"]) for r in lake.malformed_counts(lake.read_raw_csv(spark, str(us))).collect()}
    assert counts["abc.csv"] == (1, 0) and (3, 2) in counts.values()
    first = got["KR", "005930", dt.date(2020, 1, 2)]
    assert first["open"] == 1000.0 and first["turnover"] == 10500.0 and first["exchange"] is None
    abc = got["US", "ABC", dt.date(2020, 1, 2)]
    assert abc["exchange"] == "NASDAQ" and abc["volume"] == 100 and abc["turnover"] == 1100.0 and abc["adj_close"] == 10.5


def test_lake_prunes_and_replaces_partitions(spark, tmp_path):
    root = str(tmp_path / "lake")
    df = make_panel(spark, {"A": 500, "B": 500}).withColumns({"adj_close": F.col("close"), "volume": F.col("volume").cast("long"), "exchange": F.lit("X"),
                                                              "currency": F.lit("USD"), "market": F.lit("US"), "year": F.year("date")})
    lake.write_lake(df, root)
    lake.write_lake(df.where("year = 2020 and ticker = 'A'"), root)
    back = lake.load_silver(spark, root, market="us", years=[2020], tickers=["a", "b"])
    assert back.select("ticker").distinct().count() == 1 and lake.scan_lake(spark, root).where("year = 2021").select("ticker").distinct().count() == 2
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1].split("]")[0]


def test_dataset_cache_hits_and_refreshes(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for refresh in (False, False, True):
        assert lake.cached_dataset(spark, str(tmp_path), {"a": 1}, "v", build, refresh).count() == 3
    assert len(calls) == 2
    assert lake.dataset_key({"a": 1, "b": 2}, "v") == lake.dataset_key({"b": 2, "a": 1}, "v") != lake.dataset_key({"a": 1, "b": 2}, "w")


def test_episode_document_and_segments(spark, tmp_path):
    doc = tmp_path / "episodes.json"
    doc.write_text('{"episodes": [{"episode_id": 0, "ticker": "A", "event_type": "e", "start_date": "2020-01-01T00:00:00", "end_date": "2020-01-05T00:00:00", '
                   '"price_change_pct": 1.5, "feature_statistics": {"close": {"mean": 2.0}}, "mode": "buyer"}]}')
    got = lake.episodes_source(spark, str(doc), document=True).first()
    assert got["start_date"] == dt.date(2020, 1, 1) and got["feature_statistics"]["close"]["mean"] == 2.0 and "mode" not in got.asDict()
    rows = [("A", day(i), s) for i, s in enumerate("xxyyyx")]
    seg = regimes.state_segments(spark.createDataFrame(rows, "ticker string, date date, s string"), "s").orderBy("segment").collect()
    assert [(r["state"], r["bars"]) for r in seg] == [("x", 2), ("y", 3), ("x", 1)]


def test_calibration_is_monotone(spark):
    rnd = random.Random(4)
    rows = [(f"T{i}", day(0), p, int(rnd.random() < p * p)) for i, p in enumerate(rnd.random() for _ in range(800))]
    df = spark.createDataFrame(rows, "ticker string, date date, p double, y int")
    for method in ("isotonic", "sigmoid"):
        got = learn.calibrate(df, "y", "p", method).orderBy("p").toPandas()
        assert (got["calibrated"].diff().dropna() >= -1e-9).all()
        assert ((got["calibrated"] - got["y"]) ** 2).mean() <= ((got["p"] - got["y"]) ** 2).mean() + 1e-3


def test_zscore_uses_given_statistics(spark):
    df = make_panel(spark, {"A": 30}).withColumn("flat", F.lit(2.0))
    out, stats = splits.zscore_global(df, ["close", "volume", "flat"], {"volume": (10.0, 2.0)})
    got, raw = local(out), local(df)
    assert np.allclose(got["volume"], (raw["volume"] - 10) / 2) and (got["flat"] == 0).all()
    assert np.allclose(got["close"], (raw["close"] - raw["close"].mean()) / raw["close"].std())
    assert set(stats) == {"close", "volume", "flat"}


def test_exponential_means_with_gaps_match_pandas(spark):
    rng = np.random.default_rng(4)
    series = {"A": [10.0, 10.0, None, 10.0, 10.0], "B": [None, None, *[None if rng.random() < 0.4 else float(v) for v in rng.normal(100, 9, 300)]],
              "C": [None] * 7, "D": [1.0, *[None] * 90, 5.0, 6.0, None]}
    days = pd.date_range("2020-01-01", periods=400).date
    rows = [(k, days[i], v) for k, xs in series.items() for i, v in enumerate(xs)]
    d = spark.createDataFrame(rows, "ticker string, date date, x double")
    got = ewm(d, {"slow": ("x", 2 / 51), "fast": ("x", 0.5), "half": ("x", 0.9)}, block=16).orderBy("ticker", "date").toPandas()
    for k, xs in series.items():
        for name, a in (("slow", 2 / 51), ("fast", 0.5), ("half", 0.9)):
            want = pd.Series(xs, dtype=float).ewm(alpha=a, adjust=False).mean()
            np.testing.assert_allclose(got[got.ticker == k][name].to_numpy(float), want.to_numpy(), rtol=1e-11)


def test_isotonic_calibration_keeps_close_scores_apart(spark):
    rows = [(0.5, 0), (0.5, 1), (0.5 + 1e-6, 1), (0.5 + 1e-6, 1), (0.2, 0), (0.9, 0), (0.95, 1), (0.1, 1), (0.1, 0)]
    d = spark.createDataFrame(rows, "p double, y int")
    got = {r["p"]: r["calibrated"] for r in learn.calibrate(d, "y", "p").collect()}
    points = sorted({p for p, _ in rows})
    mean = lambda a, b: np.mean([y for p, y in rows if points[a] <= p <= points[b]])
    for k, p in enumerate(points):
        assert got[p] == pytest.approx(max(min(mean(i, j) for j in range(k, len(points))) for i in range(k + 1)))
    assert got[0.5] != got[0.5 + 1e-6]


def test_equity_ends_at_a_zero_price(spark):
    days = pd.date_range("2020-01-01", periods=5).date
    rows = [("A", days[i], x, 1) for i, x in enumerate([10.0, 5.0, 0.0, 0.0, 3.0])]
    d = spark.createDataFrame(rows, "ticker string, date date, close double, signal int")
    got = trades.equity_curve(d, fee=0.0).orderBy("date").collect()
    assert [r["equity"] for r in got] == pytest.approx([10000, 5000, 0, 0, 0]) and got[-1]["drawdown"] == -1


def test_policy_options(spark):
    rows = [("A", day(i), x, 0.5, 2.0, -4.0) for i, x in enumerate([-0.4, 0.0, -0.2])]
    d = spark.createDataFrame(rows, "ticker string, date date, atr_smooth double, pred_rebound_prob double, pred_expected_ret_pct double, pred_expected_dd_pct double")

    def vols(**options):
        return [r["ex_ante_vol"] for r in policy.ex_ante_vol(d, policy.Policy(vol_window=1, **options)).orderBy("date").collect()]

    assert vols() == [0.4, 0.15, 0.2] and vols(vol_abs=False) == [0.15] * 3
    assert vols(vol_floor=None) == [0.4, 1.0, 0.2] and vols(vol_floor=None, vol_abs=False) == [-0.4, 1.0, -0.2]
    scored = policy.policy_score(d, policy.Policy(risk_aversion=0.25))
    assert [r["policy_score"] for r in scored.collect()] == pytest.approx([0.5 * 0.02 - 0.25 * 0.04] * 3)
    plain = policy.score_rescale(scored, policy.Policy(rescale=False)).collect()
    assert all(r["effective_score"] == r["policy_score"] for r in plain)
