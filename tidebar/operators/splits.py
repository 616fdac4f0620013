"""Time splits, scaling, balancing and training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import by_ticker, c, trailing
from .ordered import running_totals


def calendar(df: DataFrame) -> DataFrame:
    """The distinct dates with position and count. Its size is bounded by the calendar, so it may be broadcast."""
    one = Window.partitionBy(F.lit(0))
    return df.select("date").distinct().select(
        "date", (F.row_number().over(one.orderBy("date")) - 1).alias("_pos"), F.count("*").over(one).alias("_n"))


def split_by_date(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """The last share of distinct dates goes to validation."""
    cut = F.floor(F.col("_n") * (1 - test_size))
    dates = calendar(df).select("date", F.when(F.col("_pos") < cut, "train").otherwise("valid").alias("split"))
    return df.join(F.broadcast(dates), "date")


def split_expanding(df: DataFrame, max_folds: int = 3) -> DataFrame:
    """Up to three folds over the calendar: all dates before the cut train, the next stretch tests."""
    dates = calendar(df).withColumn("_k", F.least(F.lit(max_folds), F.floor(F.col("_n") / 2)))
    folds = dates.withColumn("fold", F.explode(F.expr("sequence(0L, cast(_k - 1 as bigint))")))
    lo, hi = F.floor(F.col("_n") * (F.col("fold") + 1) / F.col("_k")), F.floor(F.col("_n") * (F.col("fold") + 2) / F.col("_k"))
    hi = F.when(F.col("fold") < F.col("_k") - 1, hi).otherwise(F.col("_n"))
    role = F.when(F.col("_pos") < lo, "train").when(F.col("_pos") < hi, "test")
    folds = folds.select("date", "fold", role.alias("role")).where(F.col("role").isNotNull())
    return df.join(F.broadcast(folds), "date")


def row_index(df: DataFrame, order: list[str]) -> DataFrame:
    """Number all rows in a total order, without putting them in one task; adds ``row_idx`` from 0 and ``n_rows``."""
    out = running_totals(df, [], list(order), {"_one": F.lit(1)}, unique=True)
    return out.select(*df.columns, F.col("_one_before").alias("row_idx"), F.col("_one_total").alias("n_rows"))


def split_walk_forward(df: DataFrame, train: float = 0.7, valid: float = 0.1, step: float = 0.1) -> DataFrame:
    """Rolling train and validation stretches over rows ordered by (date, ticker); one row per fold it belongs to. A row is
    expanded by the folds that hold it only, so small steps don't multiply it by all folds."""
    d = row_index(df, ["date", "ticker"])
    n = F.col("n_rows")
    tr, va = F.greatest(F.floor(n * train), F.lit(1)), F.greatest(F.floor(n * valid), F.lit(1))
    st = F.greatest(F.floor(n * step), va)
    whole = tr + va > n
    d = d.withColumns({"_tr": F.when(whole, F.greatest(n - va, F.lit(1))).otherwise(tr),
                       "_va": F.when(whole, n).otherwise(va), "_st": st,
                       "_last": F.when(whole, F.lit(0)).otherwise(F.floor((n - tr - va) / st))})
    d = d.withColumns({"_lo": F.greatest(F.lit(0), F.floor((F.col("row_idx") - F.col("_tr") - F.col("_va")) / F.col("_st")) + 1).cast("bigint"),
                       "_hi": F.least(F.col("_last"), F.floor(F.col("row_idx") / F.col("_st"))).cast("bigint")})
    d = d.withColumn("fold", F.explode(F.expr("CASE WHEN _lo <= _hi THEN sequence(_lo, _hi) ELSE CAST(array() AS ARRAY<BIGINT>) END")))
    at = F.col("row_idx") - F.col("fold") * F.col("_st")
    role = F.when((at >= 0) & (at < F.col("_tr")), "train").when((at >= F.col("_tr")) & (at < F.col("_tr") + F.col("_va")), "valid")
    return d.withColumn("role", role).where(F.col("role").isNotNull()).drop("_tr", "_va", "_st", "_last", "_lo", "_hi")


def split_random_strat(df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """A random share of every class to the test side, the same rows on every run."""
    d = df.withColumn("_h", F.md5(F.concat_ws("|", "ticker", F.date_format("date", "yyyy-MM-dd"), F.lit(str(seed)))))
    d = running_totals(d, [label], ["_h", "ticker", "date"], {"_one": F.lit(1)}, unique=True)
    test = F.col("_one_before") < F.ceil(F.col("_one_total") * test_size)
    return d.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_one", "_one_before", "_one_total")


def zscore_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample deviation of every column in one pass, one row per column."""
    aggs = [f(k).alias(f"_{t}_{k}") for k in cols for t, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"_m_{k}").alias("mean"), F.col(f"_s_{k}").alias("std"))
                        for k in cols])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def apply_zscore(df: DataFrame, cols: list[str], stats: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(x - mean) / std with given statistics; a deviation of about 0 counts as 1, unknown columns use (0, 1)."""
    out = {}
    for k in cols:
        m, s = stats.get(k, (0.0, 1.0))
        m = 0.0 if m is None else m
        s = 1.0 if s is None or abs(s) < 1e-12 else s
        out[k] = (c(k) - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


def zscore_global(df: DataFrame, cols: list[str], injected: dict[str, tuple[float, float]] | None = None):
    """Scale columns by statistics over all rows; given statistics win. Returns the frame and the statistics used, which
    hold one pair per column and are the only thing that passes the driver."""
    stats = dict(injected or {})
    todo = [k for k in cols if k not in stats]
    if todo:
        stats.update({r["feature"]: (r["mean"], r["std"]) for r in zscore_stats(df, todo).collect()})
    return apply_zscore(df, cols, stats), stats


def scaler_train_only(df: DataFrame, cols: list[str], split: str = "split") -> DataFrame:
    """Scale all rows by mean and population deviation of the training rows."""
    aggs = [f(k).alias(f"_{t}_{k}") for k in cols for t, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = df.where(F.col(split) == "train").agg(*aggs).withColumn("_all", F.lit(0))
    d = df.withColumn("_all", F.lit(0)).join(F.broadcast(stats), "_all")
    scaled = {k: (c(k) - c(f"_m_{k}")) / F.when(F.abs(f"_s_{k}") > 1e-12, c(f"_s_{k}")).otherwise(1.0) for k in cols}
    return d.withColumns(scaled).drop("_all", *[f"_{t}_{k}" for k in cols for t in "ms"])


def seq_windows(df: DataFrame, features: list[str], seq_len: int = 20, target: str | None = None,
                drop_nulls: bool = False) -> DataFrame:
    """For every bar with enough history, the feature rows of the last ``seq_len`` bars, oldest first."""
    d = df.withColumn("window", F.collect_list(F.struct(*features)).over(trailing(seq_len)))
    d = d.where(F.size("window") == seq_len)
    if drop_nulls:
        def gap(r):
            cond = r[features[0]].isNull()
            for k in features[1:]:
                cond = cond | r[k].isNull()
            return cond

        d = d.where(~F.exists("window", gap))
    return d.select("ticker", "date", "window", *([target] if target else []))


def seq_chunks(df: DataFrame, features: list[str], seq_len: int = 20, target: str | None = None, size: int = 512) -> DataFrame:
    """The series in pieces from which all windows can be cut: (ticker, chunk, first, bars), first the place of the first bar.

    A chunk holds ``size`` bars of its own and the ``seq_len - 1`` before them, so a bar is stored once or, near a border, twice,
    while every window as a row of its own stores it ``seq_len`` times. ``size`` is raised to ``seq_len`` at least.
    """
    size = max(size, seq_len)
    d = df.withColumn("_i", F.row_number().over(by_ticker()) - 1)
    own = (F.col("_i") / size).cast("int")
    # the last bars of a chunk also stand before the bars of the next
    late = F.col("_i") % size > size - seq_len
    d = d.withColumn("chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    bar = F.struct(F.col("_i").alias("place"), "date", *features, *([target] if target else []))
    chunks = d.groupBy("ticker", "chunk").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    chunks = chunks.where(F.element_at("bars", -1)["place"] >= F.col("chunk") * size)  # not a chunk of earlier bars alone
    return chunks.select("ticker", "chunk", F.col("bars")[0]["place"].alias("first"), "bars")


def chunk_windows(chunks: DataFrame, features: list[str], seq_len: int = 20, target: str | None = None, drop_nulls: bool = False) -> DataFrame:
    """The windows of ``seq_windows``, cut out of chunks as they are read: row filters before this see (chunk, offset) only."""
    d = chunks.where(F.size("bars") >= seq_len).withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("bars") - seq_len)))
    d = d.withColumn("_bars", F.slice("bars", F.col("offset") + 1, F.lit(seq_len)))
    if drop_nulls:
        gap = lambda r: F.greatest(*[r[k].isNull() for k in features]) if len(features) > 1 else r[features[0]].isNull()
        d = d.where(~F.exists("_bars", gap))
    last = F.element_at("_bars", -1)
    window = F.transform("_bars", lambda r: F.struct(*[r[k].alias(k) for k in features]))
    return d.select("ticker", last["date"].alias("date"), window.alias("window"), *([last[target].alias(target)] if target else []))


def class_counts(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), label).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str, classes: list, power: float = 0.5) -> DataFrame:
    """(total / count) ** power, scaled to mean 1; a class without rows takes the smallest count."""
    known = df.sparkSession.createDataFrame([(k,) for k in classes], f"{label} {df.schema[label].dataType.simpleString()}")
    one = Window.partitionBy(F.lit(0))
    n = known.join(class_counts(df, label), label, "left")
    n = n.withColumn("n", F.coalesce("n", F.min("n").over(one), F.lit(1)))
    n = n.withColumn("_raw", F.pow(F.sum("n").over(one) / F.col("n"), F.lit(power)))
    return n.select(label, "n", (F.col("_raw") / F.avg("_raw").over(one)).alias("weight"))


def oversample_balance(df: DataFrame, label: str, order: list[str], chunk: int = 10_000) -> DataFrame:
    """Repeat the rows of small classes until every class is as large as the largest; the first rows in ``order`` repeat
    once more for the remainder. Copies of a row are made in two steps with a shuffle between, so that one row repeated
    very often does not fill one task."""
    d = running_totals(df, [label], list(order), {"_one": F.lit(1)}, unique=True)
    top = df.groupBy(label).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("_top")).withColumn("_all", F.lit(0))
    d = d.withColumn("_all", F.lit(0)).join(F.broadcast(top), "_all")
    size, rest = F.col("_one_total"), F.col("_top") % F.col("_one_total")
    copies = F.floor(F.col("_top") / size) + F.when(F.col("_one_before") < rest, 1).otherwise(0)
    d = d.withColumn("_copies", copies)
    d = d.withColumn("_part", F.explode(F.expr(f"sequence(0L, cast((_copies - 1) div {chunk} as bigint))")))
    d = d.repartition(*order, "_part")
    d = d.withColumn("copy", F.explode(F.expr(f"sequence(_part * {chunk} + 1, least(cast(_copies as bigint), (_part + 1) * {chunk}))")))
    return d.select(*df.columns, "copy")


def big_move_grid(df: DataFrame, ks=(0.8, 1.0, 1.2, 1.5)) -> DataFrame:
    """Score the true range multiple k by expanding folds: precision times recall of the plain rule
    range >= k * mean atr / mean close (training dates) against the label, per non-empty test fold."""
    d = split_expanding(df)
    grid = F.explode(F.array(*[F.lit(float(k)) for k in ks]))
    train = d.where(F.col("role") == "train").groupBy("fold").agg((F.avg("atr14") / F.avg("close")).alias("_share"))
    test = d.where((F.col("role") == "test") & F.col("next_range").isNotNull()).join(F.broadcast(train), "fold").withColumn("k", grid)
    hit = F.col("next_range") >= F.col("k") * F.col("_share")
    real = F.col("next_range") >= F.col("k") * F.col("atr_share")
    s = test.groupBy("k", "fold").agg(F.count_if(hit & real).alias("_tp"), F.count_if(hit).alias("_p"), F.count_if(real).alias("_r"),
                                      F.count("*").alias("_n"))
    score = F.when((F.col("_r") > 0) & (F.col("_r") < F.col("_n")) & (F.col("_p") > 0),
                   F.col("_tp") / F.col("_p") * F.col("_tp") / F.col("_r")).otherwise(0.0)
    one = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "k")
    s = s.groupBy("k").agg(F.avg(score).alias("score"), F.count("*").alias("folds"))
    return s.withColumn("best", F.when(F.row_number().over(one) == 1, 1).otherwise(0))


