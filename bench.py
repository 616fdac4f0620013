"""Time the headline queries and print one JSON line. Reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "norm_kr", "sink_partitioned", "src_load_silver", "ds_cache", "agg_event_rate_date", "atr_v1", "rsi_v1", "macd_v2", "v2_fill", "v3_fill",
    "feature_set", "label_cls", "split_walk_forward", "turnover_rank_avg", "topn_per_date", "explorer_features", "episode_assign",
    "ep_performance", "regime_label", "policy_action", "policy_grid", "perf_stats", "metric_roc_auc", "event_pred_score", "direction_score",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tidebar.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tidebar-bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    keys = sys.argv[1:] or HEADLINE
    catalog.QUERIES["sel_columns"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    took = {}
    for key in keys:
        t = time.perf_counter()
        catalog.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[key] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
