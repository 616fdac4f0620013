"""Event episodes: assignment, local scores, extraction and analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import SERIES, c, ratio, zroll
from .explorer import EVENT_ORDER
from .ordered import exact_quantiles, pinned

STAT_FEATURES = ["close", "x_volume_z", "x_rsi_smooth", "x_macd_smooth", "x_atr_smooth", "x_pos_in_band_rel", "x_ema_spread_rel",
                 "x_local_vol_index"]
SIGNALS = [*EVENT_ORDER, "x_label_buy_soft", "x_label_sell_soft"]


def episode_assign(df: DataFrame, events: list[str] | None = None, pre: int = 5, post: int = 5) -> DataFrame:
    """Give every bar near an event the episode of the first event that claims it.

    Events are numbered per ticker by event type, then by date, and each claims the unclaimed bars from ``pre`` before to
    ``post`` after it. The first claimant of a bar is therefore the event with the smallest number in reach, and numbers
    grow with the type, so it is the first type that has any event in reach and the earliest of those. Running counts
    and one framed minimum per type give it without expanding or joining rows.
    """
    events = events or EVENT_ORDER
    seen = {f"_at{i}": F.expr(f"CASE WHEN {e} > 0 THEN sum({e}) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END")
            for i, e in enumerate(events)}
    whole = {f"_all{i}": F.expr(f"sum({e}) OVER (PARTITION BY ticker)") for i, e in enumerate(events)}
    d = df.withColumns({**seen, **whole})
    before = "0"
    near = {}
    for i in range(len(events)):
        near[f"_id{i}"] = F.expr(f"min(_at{i}) OVER ({SERIES} ROWS BETWEEN {post} PRECEDING AND {pre} FOLLOWING) + {before} - 1")
        before += f" + coalesce(_all{i}, 0)"
    d = d.withColumns(near)
    ids = [c(f"_id{i}") for i in range(len(events))]
    label = F.coalesce(*[F.when(x.isNotNull(), F.concat(F.lit(f"{e.removeprefix('x_')}:"), x.cast("string"))) for x, e in zip(ids, events)], F.lit(""))
    d = d.withColumns({"episode_id": F.coalesce(*ids, F.lit(-1)).cast("long"), "episode_label": label})
    return d.drop(*[f"_{t}{i}" for i in range(len(events)) for t in ("at", "all", "id")])


def episode_zscore(df: DataFrame, cols: dict[str, str], window: int = 15) -> DataFrame:
    """z-score inside the episode (0 when it does not vary); bars outside episodes use a rolling z-score."""
    w = Window.partitionBy("ticker", "episode_id")
    inside = {}
    for out, x in cols.items():
        sd = F.stddev_pop(x).over(w)
        z = F.when(c(x).isNull(), None).when(sd <= 1e-8, 0.0).otherwise(ratio(c(x) - F.avg(x).over(w), sd))
        inside[f"_in_{out}"] = F.when(c("episode_id") >= 0, z)
    d = df.withColumns(inside)
    d = d.withColumns({out: F.coalesce(c(f"_in_{out}"), zroll(x, window)) for out, x in cols.items()})
    return d.drop(*inside)


def episode_extract(df: DataFrame) -> DataFrame:
    """One row per episode: type, span, price change and range, and per-feature and per-signal statistics as maps."""
    d = df.where(c("episode_id") >= 0)
    aggs = [F.first("episode_label").alias("episode_label"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
            F.count("*").alias("duration_days"), F.min_by("close", "date").alias("_c0"), F.max_by("close", "date").alias("_c1"),
            F.max("high").alias("_hi"), F.min("low").alias("_lo")]
    for k in STAT_FEATURES:
        at = F.when(c(k).isNotNull(), c("date"))
        aggs.append(F.struct(
            F.avg(k).alias("mean"), F.when(F.count(k) > 1, F.stddev_samp(k)).otherwise(0.0).alias("std"), F.min(k).alias("min"), F.max(k).alias("max"),
            F.min_by(k, at).alias("start"), F.max_by(k, at).alias("end")).alias(f"_f_{k}"))
    for k in SIGNALS:
        aggs.append(F.struct(F.sum(k).cast("long").alias("active_periods"), F.max(k).cast("double").alias("max_intensity"),
                             F.avg(k).alias("avg_intensity")).alias(f"_s_{k}"))
    e = d.groupBy("ticker", "episode_id").agg(*aggs)

    def as_map(prefix, names, probe):
        entries = F.array(*[F.struct(F.lit(k.removeprefix("x_")).alias("key"), c(f"{prefix}{k}").alias("value")) for k in names])
        return F.map_from_entries(F.filter(entries, lambda x: x["value"][probe].isNotNull()))

    return e.select(
        "episode_id", "ticker", F.split_part("episode_label", F.lit(":"), F.lit(1)).alias("event_type"), "episode_label", "start_date", "end_date",
        "duration_days", (ratio(c("_c1") - c("_c0"), c("_c0")) * 100).alias("price_change_pct"),
        (ratio(c("_hi") - c("_lo"), c("_lo")) * 100).alias("max_price_range_pct"),
        as_map("_f_", STAT_FEATURES, "mean").alias("feature_statistics"), as_map("_s_", SIGNALS, "avg_intensity").alias("event_signals"),
        c("duration_days").alias("data_points"))


def episode_summary(episodes: DataFrame) -> DataFrame:
    """Counts and mean length by event type, by ticker and overall. Three plain aggregates in one pass over the episodes."""
    kinds = F.explode(F.array(F.struct(F.lit("event_type").alias("kind"), c("event_type").alias("key")),
                              F.struct(F.lit("ticker").alias("kind"), c("ticker").alias("key")),
                              F.struct(F.lit("all").alias("kind"), F.lit("all").alias("key"))))
    d = episodes.select("duration_days", kinds.alias("_k")).select("duration_days", "_k.*")
    return d.groupBy("kind", "key").agg(F.count("*").alias("episodes"), F.avg("duration_days").alias("avg_length"))


P = "price_change_pct"


def ep_performance(episodes: DataFrame) -> DataFrame:
    """Count, mean, median, deviation and success per event type. The median needs a second look at the rows, so the three
    columns in use are pinned."""
    x, episodes = c(P), pinned(episodes.select("event_type", P, "duration_days"))
    s = episodes.groupBy("event_type").agg(
        F.count("*").alias("total_episodes"), F.avg(x).alias("avg_price_change"), F.stddev_samp(x).alias("std_price_change"),
        F.count_if(x > 0).alias("positive_episodes"), (F.avg((x > 0).cast("double")) * 100).alias("success_rate"),
        F.avg("duration_days").alias("avg_duration"), F.sum(x).alias("total_return"))
    med = exact_quantiles(episodes.select("event_type", P), ["event_type"], P, {"median_price_change": 0.5})
    return s.join(med, "event_type", "left")


def ep_distribution(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("event_type").agg(
        F.count("*").alias("total_episodes"), F.avg(P).alias("avg_price_change"), (F.avg((c(P) > 0).cast("double")) * 100).alias("success_rate"),
        F.avg("duration_days").alias("avg_duration"), F.sum(P).alias("total_return"))


def ep_equal_stake(episodes: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """The capital split equally over all episodes of a type."""
    s = episodes.groupBy("event_type").agg(F.count("*").alias("num_trades"), (F.avg(P) / 100 * capital).alias("total_return"))
    return s.select("event_type", F.lit(float(capital)).alias("initial_capital"), (capital + c("total_return")).alias("final_capital"), "total_return",
                    (c("total_return") / capital * 100).alias("total_return_pct"), "num_trades",
                    (c("total_return") / c("num_trades")).alias("avg_return_per_trade"))


def ep_risk(episodes: DataFrame) -> DataFrame:
    x, many = c(P), F.count("*") > 1
    sd = F.stddev_samp(x)
    return episodes.groupBy("event_type").agg(
        F.count("*").alias("total_episodes"), F.avg(x).alias("avg_price_change"),
        F.when(many & (sd > 0), F.try_divide(F.avg(x), sd)).otherwise(0.0).alias("sharpe_ratio"), F.min(x).alias("max_drawdown"),
        (F.avg((x > 0).cast("double")) * 100).alias("win_rate"), F.when(many, sd).otherwise(0.0).alias("volatility"),
        F.max(x).alias("best_trade"), F.min(x).alias("worst_trade"))


# The four verdicts, best first.
VERDICTS = ["강력 추천", "추천", "보류", "비추천"]


def ep_recommend(episodes: DataFrame) -> DataFrame:
    """Points for mean return, Sharpe ratio, win rate, worst loss and sample size, and the verdict they lead to."""
    d = ep_risk(episodes)

    def points(x, *steps):
        out = None
        for cond, v in steps:
            out = F.when(cond(x), v) if out is None else out.when(cond(x), v)
        return out.otherwise(0.0)

    d = d.withColumns({
        "return_points": points(c("avg_price_change"), (lambda x: x > 0, 2.0)),
        "sharpe_points": points(c("sharpe_ratio"), (lambda x: x > 0.5, 2.0), (lambda x: x > 0, 1.0)),
        "win_points": points(c("win_rate"), (lambda x: x > 60, 1.0), (lambda x: x > 50, 0.5)),
        "loss_points": points(c("max_drawdown"), (lambda x: x > -5, 1.0), (lambda x: x > -10, 0.5)),
        "sample_points": points(c("total_episodes"), (lambda x: x >= 5, 1.0), (lambda x: x >= 3, 0.5)),
    })
    score = c("return_points") + c("sharpe_points") + c("win_points") + c("loss_points") + c("sample_points")
    verdict = F.when(score >= 4, VERDICTS[0]).when(score >= 3, VERDICTS[1]).when(score >= 2, VERDICTS[2]).otherwise(VERDICTS[3])
    return d.select("event_type", score.alias("recommendation_score"), verdict.alias("recommendation"), "return_points", "sharpe_points", "win_points",
                    "loss_points", "sample_points", c("avg_price_change").alias("expected_return"), "win_rate", "sharpe_ratio", "max_drawdown")


def ep_redistribute(episodes: DataFrame, band: float = 0.5) -> DataFrame:
    s = episodes.groupBy("event_type").agg(
        F.count("*").alias("count"), F.avg(P).alias("avg_return"), (F.avg((c(P) > 0).cast("double")) * 100).alias("win_rate"),
        F.max(P).alias("best_episode"), F.min(P).alias("worst_episode"), F.stddev_samp(P).alias("volatility"), F.sum(P).alias("total_return"))
    side = F.when(c("avg_return") > band, "buyer").when(c("avg_return") < -band, "seller").otherwise("neutral")
    return s.withColumn("side", side)


def _better_first(a, b):
    return F.when(a[P] > b[P], -1).when(a[P] < b[P], 1).when(a["ticker"] < b["ticker"], -1).when(a["ticker"] > b["ticker"], 1).otherwise(0)


def ep_report(episodes: DataFrame) -> DataFrame:
    """One JSON document: metadata, overall statistics, best and worst episode, the top five with their feature statistics, and
    per event type performance, side, recommendation and risk. It lists tickers and event types, nothing per episode.

    The columns in use are pinned, so building the report runs the query of the episodes."""
    brief = ["episode_id", "ticker", "event_type", P, "duration_days", "start_date", "end_date", "feature_statistics"]
    episodes = pinned(episodes.select(*brief))
    tie = F.struct(c(P), c("ticker"), c("episode_id"))
    overall = episodes.groupBy().agg(
        F.count("*").alias("total_episodes"), (F.avg((c(P) > 0).cast("double")) * 100).alias("overall_win_rate"),
        F.avg("duration_days").alias("avg_episode_duration"), F.avg(P).alias("avg_price_change"), F.max(P).alias("best_episode_return"),
        F.min(P).alias("worst_episode_return"), F.min("start_date").alias("first_date"), F.max("end_date").alias("last_date"),
        F.sort_array(F.collect_set("ticker")).alias("tickers"), F.max_by(F.struct(*brief), tie).alias("best"), F.min_by(F.struct(*brief), tie).alias("worst"))
    median = exact_quantiles(episodes.select(P), [], P, {"median_price_change": 0.5})
    top = top_episodes(episodes).groupBy().agg(F.array_sort(F.collect_list(F.struct(c(P), c("episode_id"), c("event_type"), c("ticker"), c("feature_statistics"))), _better_first).alias("top"))

    def listed(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy().agg(F.sort_array(F.collect_list(F.struct("event_type", *[k for k in d.columns if k != "event_type"]))).alias(name))

    d = overall.withColumn("_all", F.lit(0))
    for part in (median, top, listed(ep_redistribute(episodes), "types"), listed(ep_recommend(episodes), "advice"), listed(ep_risk(episodes), "risk")):
        d = d.join(F.broadcast(part.withColumn("_all", F.lit(0))), "_all", "left")
    sides = {f"{k}_events": F.expr(f"filter(types, x -> x.side = '{k}')") for k in ("buyer", "seller", "neutral")}
    moved = F.struct(F.size("types").alias("total_events"), *[F.size(v).alias(k.replace("events", "count")) for k, v in sides.items()])
    return d.select(F.to_json(F.struct(
        F.struct("total_episodes", F.struct("first_date", "last_date").alias("date_range"), c("tickers").alias("tickers_analyzed")).alias("metadata"),
        F.struct("total_episodes", "overall_win_rate", "avg_episode_duration", "avg_price_change", "median_price_change", "best_episode_return", "worst_episode_return").alias("overall_statistics"),
        c("best").alias("best_performing_episode"), c("worst").alias("worst_performing_episode"),
        F.struct(*[v.alias(k) for k, v in sides.items()], c("types").alias("all_events_performance"), moved.alias("redistribution_summary")).alias("event_performance"),
        c("top").alias("top_performing_episodes"), c("advice").alias("strategy_recommendations"), c("risk").alias("risk_metrics"))).alias("report"))


def top_episodes(episodes: DataFrame, k: int = 5) -> DataFrame:
    return episodes.orderBy(F.desc(P), "ticker", "episode_id").limit(k)
