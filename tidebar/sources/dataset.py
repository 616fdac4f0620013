"""The main entry point: from a lake of bars to a dataset of features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import drop_null_rows, ffill_prices, pick_features
from ..operators.features import add_feature_set
from ..operators.labels import future_return_labels
from ..operators.splits import zscore_global
from .lake import cached_dataset, dataset_key, lake_version, load_silver, stats_source, write_stats

Stats = dict[str, tuple[float, float]]


def build_dataset(spark: SparkSession, root: str, market=None, exchanges=None, tickers=None, years=None, start=None, end=None, max_tickers: int | None = None,
                  feature_set: str = "v1", label_horizon: int = 5, label_task: str = "regression", label_thresh: float = 0.05, columns: list[str] | None = None,
                  drop_nulls: bool = True, normalize: bool = True, stats: Stats | None = None, fill_prices: bool = False, cache: str | None = None,
                  refresh: bool = False) -> tuple[DataFrame, Stats]:
    """Filter and sample the lake, add features and labels, scale the features, drop rows with nulls, select.

    Returns the dataset and the mean and deviation that scaled each feature. Given ``stats`` win; features without any are
    measured over all rows. ``fill_prices`` carries prices over null bars before features are computed. With ``cache``, a
    folder, dataset and statistics are stored under a key of all parameters and the lake's files, and read back from there. The
    statistics are written first, so a dataset that is complete has its statistics whatever was interrupted before.
    """
    params = {"market": market, "exchanges": exchanges, "tickers": tickers, "years": years, "start": start, "end": end, "max_tickers": max_tickers, "feature_set": feature_set,
              "label_horizon": label_horizon, "label_task": label_task, "label_thresh": label_thresh, "columns": columns, "drop_nulls": drop_nulls, "normalize": normalize,
              "stats": stats, "fill_prices": fill_prices}
    used: Stats = {}
    version = lake_version(spark, root) if cache is not None else ""
    stats_path = f"{cache}/{dataset_key(params, version)}-stats"
    built = False

    def build() -> DataFrame:
        nonlocal built
        built = True
        df = load_silver(spark, root, market, exchanges, tickers, years, start, end, max_tickers)
        df = add_feature_set(ffill_prices(df) if fill_prices else df, feature_set)
        df = future_return_labels(df, label_horizon, label_task, label_thresh)
        if normalize:
            df, found = zscore_global(df, pick_features(df), stats)
            used.update(found)
        if drop_nulls:
            df = drop_null_rows(df)
        if cache is not None and normalize:
            rows = [(k, m, d) for k, (m, d) in used.items()]
            write_stats(spark.createDataFrame(rows, "feature string, mean double, std double"), stats_path)
        return df.select(*columns) if columns else df

    if cache is None:
        return build(), used
    df = cached_dataset(spark, cache, params, version, build, refresh)
    if normalize and not built:
        used = {r["feature"]: (r["mean"], r["std"]) for r in stats_source(spark, stats_path).collect()}
    return df, used
