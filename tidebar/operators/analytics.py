"""How well features predict events and directions, per date and overall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import exact_quantiles, pinned


def corr_matrix(df: DataFrame, cols: list[str], rows_out: int = 50_000) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows that have both; one row per pair.

    Rows become arrays, and each task adds up matrix products of its batches: counts, sums, squares and products of all pairs at
    once, taken from provisional means so that large values do not cancel. Tasks give out their sums, one row per pair, and
    Spark adds them; the plan is the same for three columns and for hundreds. A pair without variance has no correlation.
    """
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    values = df.select(F.array(*[F.col(x).cast("double") for x in cols]).alias("x"))
    means = df.agg(*[F.avg(F.col(x).cast("double")).alias(f"m{i}") for i, x in enumerate(cols)]).first()
    shift = np.array([m or 0.0 for m in means])
    names = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))
        for batch in batches:
            flat = batch.column(0).flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, k)
            x = np.where(known, flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, k) - shift, 0.0)
            m = known.astype(np.float64)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        at = np.array(pairs, np.int64).reshape(-1, 2)
        for a in range(0, len(at), rows_out):
            i, j = at[a:a + rows_out].T
            n, s, q, p = sums
            columns = [i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    parts = values.mapInArrow(run, "i int, j int, " + ", ".join(f"{x} double" for x in names[2:]))
    t = parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in names[2:]])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy))
    label = F.array(*[F.lit(x) for x in cols])
    r = F.when(n > 1, F.try_divide(n * F.col("sxy") - sx * sy, spread))
    return t.select(label[F.col("i")].alias("feature_a"), label[F.col("j")].alias("feature_b"), r.alias("r")).withColumn("abs_r", F.abs("r"))


def melt_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Wide to long: one row per kept columns and feature."""
    return df.unpivot(keep, features, "feature", "value")


def event_pred_score(df: DataFrame, features: list[str], label: str, need: int = 10) -> DataFrame:
    """Per (date, feature) with enough rows: event rate in the top fifth minus the bottom fifth by value, and whether the
    mean of positive events lies above that of negative ones (1, 0, or 0.5 when a side is missing)."""
    base = pinned(df.where(F.col(label).isNotNull()).select("date", "ticker", label, *features))
    long = melt_features(base, features, ["date", label]).where(F.col("value").isNotNull())
    keys = ["date", "feature"]
    cuts = exact_quantiles(long, keys, "value", {"_hi": 0.8, "_lo": 0.2}, pin=False)
    y, v = F.col(label), F.col("value")
    event = (y != 0).cast("double")
    s = long.join(cuts, keys).groupBy(*keys).agg(
        F.count("*").alias("_n"), (F.avg(F.when(v >= F.col("_hi"), event)) - F.avg(F.when(v <= F.col("_lo"), event))).alias("event_pred_score"),
        F.avg(F.when(y == 1, v)).alias("_p"), F.avg(F.when(y == -1, v)).alias("_m"))
    side = F.when(F.col("_p").isNull() | F.col("_m").isNull(), 0.5).when(F.col("_p") > F.col("_m"), 1.0).otherwise(0.0)
    return s.where(F.col("_n") >= need).select(*keys, "event_pred_score", side.alias("direction_accuracy"))


def direction_score(df: DataFrame, features: list[str], label: str, need_rows: int = 20, need_events: int = 10,
                    need_side: int = 3) -> DataFrame:
    """Per (date, feature): standardised gap between the class means of events, accuracy of the midpoint rule, and the gap
    over the summed deviations."""
    y, v = F.col(label), F.col("value")
    df = pinned(df.select("date", "ticker", label, *features))
    busy = df.groupBy("date").agg(F.count("*").alias("_rows"), F.count_if(y != 0).alias("_events")).where(
        (F.col("_rows") >= need_rows) & (F.col("_events") >= need_events)).select("date")
    events = df.where(y != 0).join(F.broadcast(busy), "date", "left_semi")
    long = melt_features(events, features, ["date", "ticker", label]).where(v.isNotNull())
    keys = ["date", "feature"]
    pos, neg = F.when(y == 1, v), F.when(y == -1, v)
    s = long.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(pos).alias("_np"), F.count(neg).alias("_nm"), F.avg(pos).alias("_p"),
                                F.avg(neg).alias("_m"), F.stddev_samp(pos).alias("_sp"), F.stddev_samp(neg).alias("_sm"))
    s = s.where((F.col("_n") >= need_events) & (F.col("_np") >= need_side) & (F.col("_nm") >= need_side))
    guess = F.when(v > (F.col("_p") + F.col("_m")) / 2, 1).otherwise(-1)
    acc = long.join(s.select(*keys, "_p", "_m"), keys).groupBy(*keys).agg(F.avg((guess == y).cast("double")).alias("direction_accuracy"))
    gap = F.abs(F.col("_p") - F.col("_m"))
    d = s.join(acc, keys)
    return d.select(*keys, F.try_divide(gap, (F.col("_sp") + F.col("_sm")) / 2 + 1e-9).alias("direction_pred_score"), "direction_accuracy",
                    F.try_divide(gap, F.col("_sp") + F.col("_sm") + 1e-9).alias("class_separation"))


def with_rolling_means(scores: DataFrame, cols: dict[str, str], n: int = 30) -> DataFrame:
    """Rolling means per feature over its dates; a feature has at most one row per calendar date."""
    w = Window.partitionBy("feature").orderBy("date").rowsBetween(-(n - 1), 0)
    return scores.withColumns({out: F.when(F.count(k).over(w) >= n, F.avg(k).over(w)) for k, out in cols.items()})


def event_pred_summary(scores: DataFrame) -> DataFrame:
    s = scores.groupBy("feature").agg(
        F.count("*").alias("n_days"), F.avg("event_pred_score").alias("event_pred_mean"), F.avg("direction_accuracy").alias("direction_acc_mean"),
        F.avg((F.col("event_pred_score") > 0).cast("double")).alias("positive_pred_rate"))
    return s.withColumn("success_rate", F.abs("event_pred_mean") * F.col("direction_acc_mean"))


def direction_summary(scores: DataFrame) -> DataFrame:
    s = scores.groupBy("feature").agg(
        F.count("*").alias("n_days"), F.avg("direction_pred_score").alias("direction_pred_mean"),
        F.avg("direction_accuracy").alias("direction_acc_mean"), F.avg("class_separation").alias("class_sep_mean"))
    return s.withColumn("success_rate", F.col("direction_acc_mean") * F.col("class_sep_mean"))


def top_features(summary: DataFrame, k: int, min_days: int = 30) -> DataFrame:
    """The best features with enough days; when none has enough, the best of all."""
    one = Window.partitionBy(F.lit(0))
    enough = (F.col("n_days") >= min_days).cast("int")
    d = summary.withColumns({"_ok": enough, "_any": F.max(enough).over(one)}).where(F.col("_ok") == F.col("_any"))
    return d.drop("_ok", "_any").orderBy(F.desc("success_rate"), "feature").limit(k)


def recommend_features(summary: DataFrame, min_days: int = 50, min_success: float = 0.25, min_accuracy: float = 0.55, k: int = 10) -> DataFrame:
    good = (F.col("n_days") >= min_days) & (F.col("success_rate") >= min_success) & (F.col("direction_acc_mean") >= min_accuracy)
    return summary.where(good).orderBy(F.desc("success_rate"), "feature").limit(k)


def monthly_event_perf(scores: DataFrame) -> DataFrame:
    s = scores.groupBy(F.date_format("date", "yyyy-MM").alias("year_month"), "feature").agg(
        F.avg("event_pred_score").alias("monthly_event_pred_mean"), F.avg("direction_accuracy").alias("monthly_direction_acc_mean"),
        F.count("*").alias("days_in_month"))
    return s.withColumn("monthly_success_rate", F.abs("monthly_event_pred_mean") * F.col("monthly_direction_acc_mean"))


def monthly_direction_perf(scores: DataFrame) -> DataFrame:
    s = scores.groupBy(F.date_format("date", "yyyy-MM").alias("year_month"), "feature").agg(
        F.avg("direction_accuracy").alias("monthly_direction_acc_mean"), F.avg("direction_pred_score").alias("monthly_direction_pred_mean"),
        F.avg("class_separation").alias("monthly_class_sep_mean"), F.count("*").alias("days_in_month"))
    return s.withColumn("monthly_success_rate", F.col("monthly_direction_acc_mean") * F.col("monthly_class_sep_mean"))
