"""Classifier and regression metrics as aggregates over score columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import c
from .ordered import exact_quantiles, pinned, running_totals


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    y, p = c(label) == 1, c(pred) == 1
    s = df.groupBy().agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (c(k) for k in ("tp", "fp", "tn", "fn"))

    def part(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return s.withColumns({
        "accuracy": part(tp + tn, tp + fp + tn + fn), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn),
        "f1": part(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (part(tp, tp + fn) + part(tn, tn + fp)) / 2})


def _by_score(df: DataFrame, label: str, score: str, by: list[str], descending: bool) -> DataFrame:
    y = c(label) == 1
    order = F.col(score).desc() if descending else F.col(score).asc()
    return running_totals(df.where(c(score).isNotNull() & c(label).isNotNull()), by, [order], {"_p": F.count_if(y), "_n": F.count_if(~y)}, keep=[score])


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half, from counts per distinct score."""
    t = _by_score(df, label, score, by or [], False)
    won = F.sum(c("_p").cast("double") * (c("_n_before") + c("_n") / 2))
    return t.groupBy(*(by or [])).agg(F.try_divide(won, F.max("_p_total").cast("double") * F.max("_n_total")).alias("roc_auc"))


def pr_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under precision over recall by trapezoids, and average precision."""
    t = _by_score(df, label, score, by or [], True)
    tp, seen = c("_p_before") + c("_p"), c("_p_before") + c("_p") + c("_n_before") + c("_n")
    prec = tp / seen
    prev = F.coalesce(F.try_divide(c("_p_before"), c("_p_before") + c("_n_before")), F.lit(1.0))
    step = F.try_divide(c("_p"), c("_p_total"))
    return t.groupBy(*(by or [])).agg(F.sum(step * (prec + prev) / 2).alias("pr_auc"), F.sum(step * prec).alias("average_precision"))


def precision_at_k(df: DataFrame, label: str, score: str, ks=(1, 3, 5, 10, 20), keys=("ticker", "date")) -> DataFrame:
    """Share of positives among the k best scores, and the share of all positives found; ties go by the keys."""
    order = [F.desc(score), *[F.col(k) for k in keys]]
    top = df.select(*keys, score, label).orderBy(*order).limit(max(ks))
    top = top.withColumn("_rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    hits = [F.count_if((c("_rn") <= k) & (c(label) == 1)).alias(f"_h{k}") for k in ks]
    got = top.groupBy().agg(F.count("*").alias("_top"), *hits).withColumn("_all", F.lit(0))
    pos = df.groupBy().agg(F.count_if(c(label) == 1).alias("_pos")).withColumn("_all", F.lit(0))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c(f"_h{k}").alias("hits")) for k in ks]))
    d = got.join(F.broadcast(pos), "_all").select("_top", "_pos", rows.alias("e")).select("_top", "_pos", "e.*")
    return d.where(c("k") <= c("_top")).select("k", "hits", (c("hits") / c("k")).alias("precision"), F.try_divide("hits", "_pos").alias("recall"))


def threshold_curve(df: DataFrame, label: str, score: str, target: float = 0.4) -> DataFrame:
    """Precision at thresholds 0.01 to 0.99 and the one chosen: the lowest reaching the target, else the most precise.
    Rows are counted per hundredth first, so the curve is summed over 100 numbers."""
    p = c(score)
    b = F.floor(p * 100)
    b = F.when(p >= (b + 1) / 100, b + 1).when(p < b / 100, b - 1).otherwise(b)
    b = F.least(F.greatest(b, F.lit(0)), F.lit(99)).cast("long")
    n = df.where(p.isNotNull()).groupBy(b.alias("_b")).agg(F.count("*").alias("_n"), F.count_if(c(label) == 1).alias("_p"))
    grid = df.sparkSession.range(1, 100).withColumnRenamed("id", "_b").join(n, "_b", "left")
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    d = grid.select((c("_b") / 100).alias("threshold"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("picked"),
                    F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("hits"))
    d = d.withColumn("precision", F.coalesce(F.try_divide("hits", "picked"), F.lit(0.0)))
    reach = c("precision") >= target
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(reach), F.when(reach, c("threshold")), F.desc("precision"), "threshold")
    return d.withColumn("chosen", F.when(F.row_number().over(order) == 1, 1).otherwise(0))


def brier(df: DataFrame, label: str, probs: list[str]) -> DataFrame:
    return df.groupBy().agg(*[F.avg(F.pow(c(p) - c(label), F.lit(2.0))).alias(f"brier_{p}") for p in probs])


def regression(df: DataFrame, pairs: dict[str, tuple[str, str]], means: list[str] | None = None) -> DataFrame:
    """Mean absolute error per (actual, predicted) pair, and plain means of further columns."""
    return df.groupBy().agg(*[F.avg(F.abs(c(a) - c(b))).alias(k) for k, (a, b) in pairs.items()], *[F.avg(m).alias(f"mean_{m}") for m in means or []])


def mean_median(df: DataFrame, cols: list[str], min_trades: int | None = None, min_drawdown: float = 1.0) -> DataFrame:
    """Mean and median of every column of a results table, one row per column. With ``min_trades`` only results with enough
    trades and a drawdown that shows the strategy was exposed are counted, and the number of rows is added."""
    if min_trades is not None:
        df = df.where((c("trades") >= min_trades) & (F.abs("max_drawdown_pct") >= min_drawdown))
    long = pinned(df.select(*[c(k).cast("double").alias(k) for k in cols])).unpivot([], cols, "statistic", "value").where("value is not null")
    s = long.groupBy("statistic").agg(F.count("*").alias("count"), F.avg("value").alias("mean"))
    return s.join(exact_quantiles(long, ["statistic"], "value", {"median": 0.5}), "statistic")
