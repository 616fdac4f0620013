"""Cross-sections of one date: ranks, top lists and weights. A date may hold any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import c, lag, ratio
from .ordered import add_ranks
from .splits import calendar


def turnover_rank_dense(df: DataFrame) -> DataFrame:
    """Dense rank of turnover per date, its value on the ticker's previous row, and top-100/top-300 flags."""
    d = add_ranks(df, ["date"], "turnover").withColumnRenamed("dense_rank", "turnover_rank_today").drop("first_rank", "average_rank")
    d = d.withColumns({"turnover_ratio_1d": ratio(c("turnover"), lag("turnover")), "turnover_rank_prev1": lag("turnover_rank_today")})
    prev = c("turnover_rank_prev1")
    return d.withColumns({f"is_top{n}_prev1": F.when(prev <= n, 1).when(prev > n, 0) for n in (100, 300)})


def turnover_rank_avg(df: DataFrame, missing: int = 9999) -> DataFrame:
    """Average-tie rank per date, cut to a whole number and read on the next market date; a ticker absent on the market
    date before gets ``missing``."""
    d = df.withColumn("_t", F.coalesce("turnover", F.lit(0.0)))
    ranked = add_ranks(d.select("date", "ticker", "_t"), ["date"], "_t")
    cal = calendar(df)
    nxt = cal.withColumn("_next", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))).select("date", "_next")
    prev = (ranked.join(F.broadcast(nxt), "date").where(F.col("_next").isNotNull())
            .select(F.col("_next").alias("date"), "ticker", F.floor("average_rank").cast("long").alias("turnover_rank_prev1")))
    change = F.when(lag("turnover") != 0, ratio(c("turnover"), lag("turnover")) - 1)
    out = df.withColumn("turnover_ratio_1d", F.coalesce(change, F.lit(0.0))).join(prev, ["date", "ticker"], "left")
    return out.withColumn("turnover_rank_prev1", F.coalesce("turnover_rank_prev1", F.lit(missing)))


def liquidity_weights(df: DataFrame, label: str, rank: str = "turnover_rank_prev1") -> DataFrame:
    """Inverse class frequency times a tier weight by the rank on the day before."""
    counts = df.groupBy(label).agg(F.count("*").alias("_class_n"))
    r = c(rank)
    tier = F.when((r >= 1) & (r <= 100), 2.0).when((r > 100) & (r <= 300), 1.5).when((r > 300) & (r <= 1000), 1.2).otherwise(1.0)
    return df.join(counts, label).withColumn("weight", tier / F.col("_class_n")).drop("_class_n")


def sample_weights(df: DataFrame, w_top: float = 3.0, w_mid: float = 1.5, w_base: float = 1.0) -> DataFrame:
    return df.withColumn("weight", F.when(c("is_top100_prev1") == 1, w_top).when(c("is_top300_prev1") == 1, w_mid).otherwise(w_base))


def topn_per_date(df: DataFrame, score: str, n: int = 20, rank: str = "score_rank") -> DataFrame:
    """Rows whose dense rank of the score within the date is at most ``n``, ties kept.

    Only distinct scores are ranked, and the rank limit is applied before they are shuffled. The list that is joined
    back has at most ``n`` rows per calendar date, so it is broadcast whatever the size of the dates, for ``n`` up to 1000.
    """
    w = Window.partitionBy("date").orderBy(F.desc(score))
    top = (df.where(F.col(score).isNotNull()).select("date", score).distinct()
           .withColumn(rank, F.dense_rank().over(w)).where(F.col(rank) <= n))
    return df.join(F.broadcast(top) if n <= 1000 else top, ["date", score])


def daily_topk_precision(df: DataFrame, prob: str, label: str, k: int = 5) -> DataFrame:
    """Per date the exact top ``k`` by probability (ties by ticker) and the share with a positive label. The row-number
    limit is applied inside every task before the shuffle."""
    w = Window.partitionBy("date").orderBy(F.desc(prob), "ticker")
    top = (df.where(F.col(prob).isNotNull()).select("date", "ticker", prob, label)
           .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k))
    return top.groupBy("date").agg(F.count("*").alias("picked"), F.sum(F.col(label).cast("long")).alias("hits"),
                                   F.avg(F.col(label).cast("double")).alias("precision"))
