"""Registered queries against their SQL on DuckDB. By default a cross-section at the smallest scale; TIDEBAR_ALL=1 runs all."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
SOME = ["parse_numf", "norm_kr", "norm_us", "src_ingest_tree", "src_load_silver", "flt_bars", "ffill_bfill_zero", "join_left_panel", "agg_event_rate_date",
        "corr_matrix", "dedupe", "atr_v1", "rsi_v1", "macd_v2", "cci20", "v3_fill", "curv_2", "smoothers", "days_since_event", "label_big_move",
        "split_walk_forward", "split_random_strat", "oversample_balance", "turnover_rank_avg", "topn_per_date", "x_rsi_wilder", "episode_assign", "episode_zscore",
        "ep_performance", "regime_label", "regime_label_simple", "regime_transition", "policy_action", "policy_grid", "trades_long_flat", "perf_stats",
        "metric_roc_auc", "metric_pr_auc", "threshold_curve", "event_pred_score", "stream_ingest",
        "stream_correction", "build_dataset", "policy_quantiles", "regime_cluster", "calibrate_isotonic", "ep_report_fields", "cci20_ranges"]
KEYS = sorted(entry.oracle_sql()) if os.environ.get("TIDEBAR_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    result = compare(spark, con, key, SF, entry.queries(), entry.oracle_sql())
    assert result.startswith("ok"), result


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
