"""Normalising raw bars, filters, null handling and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import bfill, c, ffill
from ..functions.text import parse_date, parse_numf, parse_numi, resolve_columns

SILVER = ["date", "open", "high", "low", "close", "adj_close", "volume", "turnover", "ticker", "market", "exchange",
          "currency", "year"]
BASE_COLUMNS = set(SILVER)


_FLAT = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def _flat_order(df: DataFrame, order: list[str | Column], rest: list[str]) -> Column | None:
    """One number that orders rows as ``order`` does and tells rows with equal order apart by a hash of their values; None
    where ``order`` is more than one number or date."""
    low = F.xxhash64(*rest)
    if not order:
        return low
    if len(order) > 1:
        return None
    kind = df.select(c(order[0]).alias("o")).schema[0].dataType
    first = F.col("_order")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
        return F.shiftleft(F.coalesce(first.cast("int"), F.lit(-2**31)).cast("long"), 32) + F.pmod(low, F.lit(2**32))
    if isinstance(kind, (T.DateType, T.LongType)):
        first = F.unix_date(first) if isinstance(kind, T.DateType) else first
        return F.coalesce(first, F.lit(-2**63)).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.pmod(low, F.lit(10**18)).cast("decimal(18,0)")
    return None


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the last in ``order``. An aggregate with map-side combine, so a key with very many copies sends
    one row per task instead of filling one task. ``order`` should tell rows of a key apart; a hash of the values breaks ties.

    Hash aggregation keeps only values of fixed width: numbers and dates ordered by one number stay in it, while texts outside
    the keys or a text as order make Spark sort the rows of each task first. Rows without order come before all others.
    """
    rest = [k for k in df.columns if k not in keys]
    flat = _flat_order(df, order, rest) if all(isinstance(df.schema[k].dataType, _FLAT) for k in rest) else None
    if flat is not None:
        rows = df.withColumn("_order", c(order[0])) if order else df
        rows = rows.withColumn("_at", flat).drop("_order")
        return rows.groupBy(*keys).agg(*[F.max_by(k, "_at").alias(k) for k in rest]).select(*df.columns)
    row = F.struct(*rest)
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order, *rest)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def _finish(df: DataFrame, seq: str | None, market: str, currency: str) -> DataFrame:
    """The last bar per ticker and date as a silver row. What is the same in all rows joins after the choice."""
    best = keep_last(df.where(F.col("date").isNotNull()), ["ticker", "date"], [F.col(seq)] if seq else [])
    if "exchange" not in df.columns:
        best = best.withColumn("exchange", F.lit(None).cast("string"))
    return best.withColumns({"market": F.lit(market), "currency": F.lit(currency), "year": F.year("date")}).select(*SILVER)


def norm_kr(df: DataFrame, ticker: str | Column = "ticker", seq: str | None = None) -> DataFrame:
    """Raw text bars with yyyyMMdd dates and a traded value column, to silver bars."""
    got = resolve_columns(df, {k: [k] for k in ("date", "open", "high", "low", "close", "volume", "value")})
    f = {k: parse_numf(got[k]) for k in ("open", "high", "low", "close", "value")}
    keep = [F.col(seq)] if seq else []
    out = df.select(
        parse_date(got["date"], "yyyyMMdd").alias("date"), *[f[k].alias(k) for k in ("open", "high", "low", "close")],
        f["close"].alias("adj_close"), parse_numi(got["volume"]).alias("volume"), f["value"].alias("turnover"),
        F.upper(c(ticker)).alias("ticker"), *keep,
    )
    return _finish(out, seq, "KR", "KRW")


def norm_us(df: DataFrame, ticker: str | Column = "ticker", exchange: str | Column | None = None,
            seq: str | None = None) -> DataFrame:
    """Raw text bars with dd-MM-yyyy dates, to silver bars; turnover is close times volume."""
    got = resolve_columns(df, {"date": ["date"], "open": ["open"], "high": ["high"], "low": ["low"], "close": ["close"],
                               "volume": ["volume"], "adj_close": ["adjustedclose", "adjclose", "close"]})
    close, volume = parse_numf(got["close"]), parse_numi(got["volume"])
    keep = [F.col(seq)] if seq else []
    if exchange is not None:
        keep.append(F.upper(c(exchange)).alias("exchange"))
    out = df.select(
        parse_date(got["date"], "dd-MM-yyyy").alias("date"), *[parse_numf(got[k]).alias(k) for k in ("open", "high", "low")],
        close.alias("close"), parse_numf(got["adj_close"]).alias("adj_close"), volume.alias("volume"),
        (close * volume).alias("turnover"), F.upper(c(ticker)).alias("ticker"), *keep,
    )
    return _finish(out, seq, "US", "USD")


def canon_prices(df: DataFrame, market: str = "US", currency: str = "USD", seq: str | None = None) -> DataFrame:
    """A vendor price frame to the base schema. Column names may carry spaces and capitals, adj_close may be missing,
    a missing volume counts as 0, and the last row per (ticker, date) wins."""
    got = resolve_columns(df, {"ticker": ["ticker", "symbol"], "date": ["date"], "open": ["open"], "high": ["high"],
                               "low": ["low"], "close": ["close"], "volume": ["volume"],
                               "adj_close": ["adjclose", "adjustedclose", "close"]})
    volume = F.coalesce(F.col(got["volume"]).cast("double"), F.lit(0.0))
    close = F.col(got["close"]).cast("double")
    keep = [F.col(seq)] if seq else []
    out = df.select(
        F.col(got["date"]).cast("date").alias("date"),
        *[F.col(got[k]).cast("double").alias(k) for k in ("open", "high", "low", "close")],
        F.coalesce(F.col(got["adj_close"]).cast("double"), close).alias("adj_close"), volume.alias("volume"),
        (close * volume).alias("turnover"), F.upper(F.trim(F.col(got["ticker"]))).alias("ticker"), *keep,
    )
    return _finish(out, seq, market, currency)


def filter_bars(df: DataFrame, market: str | None = None, exchanges=None, tickers=None, years=None, start=None,
                end=None) -> DataFrame:
    """Keep bars matching every condition given. Plain comparisons, so they reach partitions and Parquet statistics."""
    if market is not None:
        df = df.where(F.col("market") == market.upper())
    if years:
        df = df.where(F.col("year").isin([int(y) for y in years]))
    if exchanges:
        df = df.where(F.col("exchange").isin([e.upper() for e in exchanges]))
    if tickers:
        df = df.where(F.col("ticker").isin([t.strip().upper() for t in tickers]))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def sample_tickers(df: DataFrame, max_tickers: int | None = None, seed: int = 42) -> DataFrame:
    """Keep all bars of ``max_tickers`` tickers picked by a hash of their name, so the choice never depends on order."""
    if max_tickers is None:
        return df
    picked = (df.select("ticker").distinct()
              .orderBy(F.md5(F.concat("ticker", F.lit(str(seed)))), "ticker").limit(int(max_tickers)))
    return df.join(picked, "ticker", "left_semi")


def pick_features(df: DataFrame, target: str | None = None) -> list[str]:
    """Numeric columns that are neither base columns nor labels nor future returns. Flags are integers and stay out: they are
    never scaled."""
    numeric = {"double", "float", "decimal"}
    return [f.name for f in df.schema.fields
            if f.dataType.typeName().split("(")[0] in numeric and f.name not in BASE_COLUMNS and f.name != target
            and not f.name.startswith(("label_", "futret_"))]


def drop_null_rows(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in a required column; by default in any column that is not a base column."""
    need = [k for k in df.columns if k not in BASE_COLUMNS] if required is None else required
    missing = [k for k in need if k not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.dropna(subset=need) if need else df


def dropna_prefix(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    cols = [k for k in df.columns if k.startswith(tuple(prefixes))]
    return df.dropna(subset=cols) if cols else df


def event_filter(df: DataFrame, target: str = "futret_1", thresh: float = 0.05) -> DataFrame:
    return df.where(F.abs(target) >= thresh)


def ffill_prices(df: DataFrame) -> DataFrame:
    """Carry the four prices forward over null bars of a ticker; nulls before its first price stay."""
    return df.withColumns({k: ffill(k) for k in ("open", "high", "low", "close")})


def ffill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({k: F.coalesce(ffill(k), F.lit(0.0)) for k in cols})


def ffill_bfill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({k: F.coalesce(ffill(k), bfill(k), F.lit(0.0)) for k in cols})


def inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    top = F.lit(float("inf"))
    return df.withColumns({k: F.when(F.abs(F.nanvl(c(k), F.lit(None).cast("double"))) < top, c(k)) for k in cols})


def ticker_quality(df: DataFrame, features: list[str], max_null_ratio: float = 0.3, min_rows: int = 50) -> DataFrame:
    """Keep the bars of tickers with few nulls over the features and enough rows."""
    nulls = sum((F.col(k).isNull().cast("int") for k in features[1:]), F.col(features[0]).isNull().cast("int"))
    good = (df.groupBy("ticker").agg(F.avg(nulls / len(features)).alias("_ratio"), F.count("*").alias("_rows"))
            .where((F.col("_ratio") < max_null_ratio) & (F.col("_rows") >= min_rows)).select("ticker"))
    return df.join(good, "ticker", "left_semi")


def zero_volume_shares(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.count("*").alias("rows"), F.count_if(F.col("volume") == 0).alias("zero_rows")).withColumn(
        "zero_ratio", F.col("zero_rows") / F.col("rows"))


def zero_volume_quality(df: DataFrame, max_ratio: float = 0.8) -> DataFrame:
    """Drop the bars of tickers that hardly trade."""
    return df.join(zero_volume_shares(df).where(F.col("zero_ratio") > max_ratio), "ticker", "left_anti")


def quick_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first_date"),
                  F.max("date").alias("last_date"))
