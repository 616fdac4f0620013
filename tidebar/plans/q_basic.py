"""Queries for sources, cleaning, joins, plain aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import c
from ..functions.text import parse_date, parse_numf, parse_numi, tidy_codes
from ..operators import clean as cl
from ..operators import panel as pn
from ..operators import splits as sp
from ..operators.features import atr_v1
from ..operators.regime_block import EVENTS, m002_features
from ..sources import lake
from . import inputs as inp
from .inputs import bars, table, tick_bars
from .registry import cte, query, shown, sr, with_
from .sql_panel import step

# ---- raw text ----

ODD_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN concat({fmt}, ' KRW') WHEN 1 THEN concat('  ', {fmt}) WHEN 2 THEN ''
 WHEN 3 THEN 'N/A' WHEN 4 THEN concat({fmt}, ' EUR') ELSE concat('-', CAST(o_custkey AS {s}), 'e-2') END"""
SPARK_TEXT = ODD_TEXT.format(fmt="format_number(o_totalprice, 2)", s="STRING")
DUCK_TEXT = ODD_TEXT.format(fmt="format('{:,.2f}', o_totalprice)", s="VARCHAR")
NUMF = "TRY_CAST(nullif(regexp_replace(trim({}), '[^0-9eE.+-]', '', 'g'), '') AS DOUBLE)"


@query("parse_numf", f"SELECT o_orderkey, {NUMF.format('t')} AS amount FROM (SELECT o_orderkey, {DUCK_TEXT} AS t FROM orders)")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.expr(SPARK_TEXT).alias("t"))
    return d.select("o_orderkey", parse_numf("t").alias("amount"))


@query("parse_numi", f"SELECT o_orderkey, CAST(coalesce(TRY_CAST(round({NUMF.format('t')}) AS BIGINT), -1) AS BIGINT) AS amount "
                     f"FROM (SELECT o_orderkey, {DUCK_TEXT} AS t FROM orders)")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.expr(SPARK_TEXT).alias("t"))
    return d.select("o_orderkey", F.coalesce(parse_numi("t"), F.lit(-1)).alias("amount"))


@query("fn_string_date", """
SELECT o_orderkey, upper(trim(concat(' ', o_orderpriority, ' '))) AS code, split_part(concat('event_', lower(o_orderstatus), ':', o_orderkey), ':', 1) AS kind,
       regexp_replace(o_orderpriority, '[0-9]-', '') AS word, CAST(starts_with(o_orderpriority, '1') AS BIGINT) AS urgent,
       strftime(o_orderdate, '%Y-%m') AS year_month, CAST(year(o_orderdate) AS BIGINT) AS year,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days,
       strftime(CAST(o_orderdate AS DATE) - 400, '%Y-%m-%d') AS shifted,
       strftime(CAST(strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y') AS DATE), '%Y-%m-%d') AS parsed
FROM orders""")
def _(spark, sf):
    o, d = table(spark, sf, "orders"), F.col("o_orderdate").cast("date")
    return shown(o.select(
        "o_orderkey", F.upper(F.trim(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))).alias("code"),
        F.split_part(F.concat(F.lit("event_"), F.lower("o_orderstatus"), F.lit(":"), "o_orderkey"), F.lit(":"), F.lit(1)).alias("kind"),
        F.regexp_replace("o_orderpriority", "[0-9]-", "").alias("word"), F.startswith(c("o_orderpriority"), F.lit("1")).alias("urgent"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.year(d).alias("year"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"),
        F.date_sub(d, 400).alias("shifted"), parse_date(F.date_format(d, "dd-MM-yyyy"), "dd-MM-yyyy").alias("parsed")))


@query("fn_sigmoid_clip", f"SELECT o_orderkey, {sr('1 / (1 + exp(-least(greatest((o_totalprice - 250000) / 50000, -3), 3)))')} AS share, "
                          f"{sr('power(abs(o_totalprice - 250000) / 1000, 0.5)')} AS root FROM orders")
def _(spark, sf):
    x = F.least(F.greatest((F.col("o_totalprice") - 250000) / 50000, F.lit(-3.0)), F.lit(3.0))
    return shown(table(spark, sf, "orders").select("o_orderkey", (1 / (1 + F.exp(-x))).alias("share"),
                                                   F.pow(F.abs(F.col("o_totalprice") - 250000) / 1000, 0.5).alias("root")))


@query("tickers_normalize", """
SELECT c_custkey, array_to_string(list_filter([upper(trim(c_mktsegment)), upper(trim(c_name)), 'X1'], lambda v, i: v <> '' AND
  list_position([upper(trim(c_mktsegment)), upper(trim(c_name)), 'X1'], v) = i), ',') AS codes FROM customer""")
def _(spark, sf):
    arr = F.array(F.concat(F.lit(" "), F.lower("c_mktsegment")), F.lit(" "), c("c_mktsegment"), F.lower("c_name"), F.lit("x1 "), c("c_name"))
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws(",", tidy_codes(arr)).alias("codes"))


# ---- raw bars, rendered as text with blanks, bad dates and repeated rows ----

def raw_kr(spark, sf):
    d = bars(spark, sf, dims=True).withColumn("_copy", F.explode(F.expr("CASE WHEN close > open THEN array(0, 1) ELSE array(0) END")))
    day = F.when(F.col("volume") % 13 == 0, "n.a.").otherwise(F.date_format("date", "yyyyMMdd"))
    text = {k: F.format_number(k, 4) for k in ("open", "high", "low", "close")}
    return d.select(day.alias("date"), *[v.alias(k) for k, v in text.items()],
                    F.concat(F.format_number(F.col("volume") + F.col("_copy"), 0), F.lit(" ")).alias("volume"),
                    F.format_number("turnover", 2).alias("value"), "ticker", "exchange", "_copy")


cte("raw_kr", "bars", """
SELECT CASE WHEN volume % 13 = 0 THEN NULL ELSE date END AS date, ticker, exchange,
  TRY_CAST(format('{:.4f}', open) AS DOUBLE) AS open, TRY_CAST(format('{:.4f}', high) AS DOUBLE) AS high,
  TRY_CAST(format('{:.4f}', low) AS DOUBLE) AS low, TRY_CAST(format('{:.4f}', close) AS DOUBLE) AS close,
  CAST(volume + CASE WHEN close > open THEN 1 ELSE 0 END AS BIGINT) AS volume, turnover FROM bars""")
SILVER_SQL = ("strftime(date, '%Y-%m-%d') AS date, open, high, low, close, {adj} AS adj_close, volume, {turn} AS turnover, ticker, "
              "'{m}' AS market, {ex} AS exchange, '{cur}' AS currency, CAST(year(date) AS BIGINT) AS year")


@query("tick_bars", """SELECT event_type AS ticker, strftime(ts, '%Y-%m-%d %H:00') AS hour, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def _(spark, sf):
    return shown(tick_bars(spark, sf), 8)


@query("norm_kr", with_("raw_kr", "SELECT " + SILVER_SQL.format(adj="close", turn="turnover", m="KR", ex="CAST(NULL AS VARCHAR)", cur="KRW")
                        + " FROM raw_kr WHERE date IS NOT NULL"))
def _(spark, sf):
    return shown(cl.norm_kr(raw_kr(spark, sf), seq="_copy"))


@query("norm_us", with_("raw_kr", "SELECT " + SILVER_SQL.format(adj="close", turn=sr("close * volume", 4), m="US", ex="upper(exchange)", cur="USD")
                        + " FROM raw_kr WHERE date IS NOT NULL"))
def _(spark, sf):
    raw = raw_kr(spark, sf)
    us = raw.select(F.when(F.col("date") != "n.a.", F.concat_ws("-", F.substring("date", 7, 2), F.substring("date", 5, 2), F.substring("date", 1, 4)))
                    .alias("Date"), F.col("low").alias("Low"), F.col("open").alias(" Open"), F.col("volume").alias("VOLUME"),
                    F.col("high").alias("High"), F.col("close").alias("Close"), F.col("close").alias("Adjusted Close"),
                    F.col("ticker").alias("t"), F.lower("exchange").alias("e"), "_copy")
    return shown(cl.norm_us(us, "t", "e", seq="_copy"), {"*": 4})


@query("canon_prices", with_("bars", """SELECT strftime(date, '%Y-%m-%d') AS date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low,
  round(close, 8) AS close, round(close, 8) AS adj_close, coalesce(v, 0) AS volume, round(close * coalesce(v, 0), 8) + 0.0 AS turnover, ticker, 'US' AS market,
  CAST(NULL AS VARCHAR) AS exchange, 'USD' AS currency, CAST(year(date) AS BIGINT) AS year
  FROM (SELECT *, CASE WHEN volume % 5 = 0 THEN NULL ELSE volume + CASE WHEN close > open THEN 1 ELSE 0 END END AS v FROM bars)"""))
def _(spark, sf):
    d = bars(spark, sf).withColumn("_copy", F.explode(F.expr("CASE WHEN close > open THEN array(0, 1) ELSE array(0) END")))
    v = F.when(F.col("volume") % 5 == 0, None).otherwise(F.col("volume") + F.col("_copy"))
    vendor = d.select(F.lower("ticker").alias("Symbol"), F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
                      F.col("low").alias("Low"), F.col("close").alias("Close"), v.alias("Volume"), "_copy")
    return shown(cl.canon_prices(vendor, seq="_copy"), 8)


# ---- files ----

COUNT_LAKE = "market, CAST(year AS BIGINT) AS year, count(*) AS rows, count(DISTINCT ticker) AS tickers, CAST(sum(volume) AS BIGINT) AS volume"


def _lake_summary(df):
    return shown(df.groupBy("market", "year").agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"),
                                                  F.sum("volume").cast("long").alias("volume")))


def _lake(spark, sf):
    root = lake.new_folder(spark, "lake")
    b = bars(spark, sf, dims=True).withColumns({"adj_close": F.col("close"), "volume": F.col("volume").cast("long")})
    lake.write_lake(b, root)
    return root


cte("raw_ok", "raw_kr", "SELECT *, CAST(year(date) AS BIGINT) AS year FROM raw_kr WHERE date IS NOT NULL")


@query("src_csv_batched", with_("raw_ok", f"SELECT ticker, count(*) AS rows, CAST(sum(volume) AS BIGINT) AS volume, {sr('sum(close)', 3)} AS close_sum FROM raw_ok GROUP BY ticker"))
def _(spark, sf):
    path = lake.new_folder(spark, "csv")
    raw_kr(spark, sf).select("date", "open", "high", "low", "close", "volume", "value", "ticker", "_copy").write.option("header", True).csv(path)
    raw = lake.read_raw_csv(spark, path)
    d = cl.norm_kr(raw, seq="_copy")
    return shown(d.groupBy("ticker").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"), F.sum("close").alias("close_sum")), 3)


@query("src_ingest_tree", with_("raw_ok", """SELECT market, coalesce(exchange, '-') AS exchange, count(*) AS rows, count(DISTINCT ticker) AS tickers,
  CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT 'KR' AS market, NULL AS exchange, ticker, volume FROM raw_ok
  UNION ALL SELECT 'US', CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 THEN 'NASDAQ' ELSE 'NYSE' END, ticker, volume FROM raw_ok) GROUP BY ALL"""))
def _(spark, sf):
    kr, us = lake.new_folder(spark, "kr"), lake.new_folder(spark, "us")
    raw = raw_kr(spark, sf)
    place = F.when(F.substring("ticker", 2, 9).cast("long") % 2 == 0, "nasdaq").otherwise("nyse")
    fields = ["date", "open", "high", "low", "close", "volume", "value"]
    raw.repartition("ticker").select(*fields, "ticker").write.partitionBy("ticker").option("header", True).csv(kr)
    u = raw.select(F.when(F.col("date") != "n.a.", F.concat_ws("-", F.substring("date", 7, 2), F.substring("date", 5, 2), F.substring("date", 1, 4))).alias("Date"),
                   F.col("low").alias("Low"), F.col("open").alias("Open"), F.col("volume").alias("Volume"), F.col("high").alias("High"),
                   F.col("close").alias("Close"), F.col("close").alias("Adjusted Close"), "ticker", place.alias("exchange"))
    u.repartition("ticker").write.partitionBy("exchange", "ticker").option("header", True).csv(us)
    d = lake.ingest_tree(spark, kr, us, r"ticker=([^/]+)/", r"exchange=([^/]+)/")
    return d.groupBy("market", F.coalesce("exchange", F.lit("-")).alias("exchange")).agg(
        F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"), F.sum("volume").alias("volume"))


@query("sink_partitioned", with_("bars", f"SELECT {COUNT_LAKE} FROM bars GROUP BY ALL"))
def _(spark, sf):
    return _lake_summary(lake.scan_lake(spark, _lake(spark, sf)))


@query("src_scan_lake", with_("bars", f"SELECT {COUNT_LAKE} FROM bars WHERE market = 'ASIA' AND year IN (1996, 1997) GROUP BY ALL"))
def _(spark, sf):
    return _lake_summary(cl.filter_bars(lake.scan_lake(spark, _lake(spark, sf)), market="asia", years=[1996, 1997]))


@query("src_load_silver", with_("bars", """SELECT strftime(date, '%Y-%m-%d') AS date, ticker, round(close, 8) AS close, CAST(volume AS BIGINT) AS volume FROM bars
  WHERE date >= DATE '1996-01-01' AND ticker IN (SELECT ticker FROM (SELECT DISTINCT ticker FROM bars WHERE date >= DATE '1996-01-01')
  ORDER BY md5(ticker || '42'), ticker LIMIT 5)"""))
def _(spark, sf):
    return shown(lake.load_silver(spark, _lake(spark, sf), start="1996-01-01", max_tickers=5, columns=["date", "ticker", "close", "volume"]), 8)


FEATS = ["atr5", "atr14"]


@query("ds_cache", with_("v1", f"SELECT ticker, count(*) AS rows, {sr('avg(atr14)', 3)} AS mean_atr14 FROM v1 GROUP BY ticker"))
def _(spark, sf):
    root = _lake(spark, sf)
    folder = lake.new_folder(spark, "cache")
    params = {"feature_set": "v1", "label_horizon": 5}

    def build():
        return atr_v1(lake.scan_lake(spark, root)).select("ticker", "date", *FEATS)

    version = lake.lake_version(spark, root)
    lake.cached_dataset(spark, folder, params, version, build)
    hit = lake.cached_dataset(spark, folder, params, version, lambda: 1 / 0)
    return shown(hit.groupBy("ticker").agg(F.count("*").alias("rows"), F.avg("atr14").alias("mean_atr14")), 3)


step("ds0", "v1", futret_5="lead(close, 5) OVER w / close - 1", n_all="count(*) OVER ()")
DS_SHOWN = ["atr14", "rsi5", "ret_5"]
DS_STATS = ", ".join(f"avg({k}) AS m_{k}, stddev_samp({k}) AS s_{k}" for k in DS_SHOWN)
cte("ds_stats", "ds0", f"SELECT {DS_STATS} FROM ds0")


@query("build_dataset", with_("ds0 ds_stats", "SELECT ticker, strftime(date, '%Y-%m-%d') AS date, " + ", ".join(sr(f"({k} - m_{k}) / s_{k}", 5) + f" AS {k}" for k in DS_SHOWN)
                              + f", {sr('futret_5', 5)} AS futret_5, CAST(CASE WHEN futret_5 >= 0.05::DOUBLE THEN 1 WHEN futret_5 <= -0.05::DOUBLE THEN -1 ELSE 0 END AS BIGINT) AS label_5d_cls "
                              "FROM ds0, ds_stats WHERE futret_5 IS NOT NULL AND logret_1 IS NOT NULL AND ret_5 IS NOT NULL AND atr5 IS NOT NULL AND atr10 IS NOT NULL AND atr14 IS NOT NULL "
                              "AND vwap10 IS NOT NULL AND vwap20 IS NOT NULL AND rsi5 IS NOT NULL AND rsi10 IS NOT NULL AND rsi14 IS NOT NULL"))
def _(spark, sf):
    from ..sources.dataset import build_dataset

    root, cache = _lake(spark, sf), lake.new_folder(spark, "cache")
    keep = ["ticker", "date", *DS_SHOWN, "futret_5", "label_5d_cls"]
    options = {"label_task": "classification", "columns": keep, "cache": cache}
    _, stats = build_dataset(spark, root, **options)  # stored
    d, again = build_dataset(spark, root, **options)  # read back, with its statistics
    if stats != again:
        raise AssertionError("statistics changed in the cache")
    return shown(d, 5)


@query("stats_source", with_("v1", " UNION ALL ".join(
    f"SELECT '{k}' AS feature, {sr(f'avg({k})', 3)} AS mean, {sr(f'stddev_samp({k})', 3)} AS std FROM v1" for k in FEATS)
    + " UNION ALL SELECT 'flat' AS feature, 3.0 AS mean, 1.0 AS std"))
def _(spark, sf):
    path = lake.new_folder(spark, "stats")
    d = atr_v1(bars(spark, sf)).withColumn("flat", F.lit(3.0))
    lake.write_stats(sp.zscore_stats(d, [*FEATS, "flat"]), path)
    return shown(lake.stats_source(spark, path), 3)


@query("tables_sink", with_("lab", "SELECT fmt, strftime(date, '%Y-%m-%d') AS date, rate AS event_rate FROM "
                            f"(SELECT date, {sr('avg(CASE WHEN label_1d_cls <> 0 THEN 1.0 ELSE 0.0 END)')} AS rate FROM lab GROUP BY date), "
                            "(SELECT unnest(['csv', 'json']) AS fmt)"))
def _(spark, sf):
    d = shown(inp.labelled(spark, sf).groupBy("date").agg(F.avg((F.col("label_1d_cls") != 0).cast("double")).alias("event_rate")))
    out = None
    for fmt in ("csv", "json"):
        path = lake.new_folder(spark, fmt)
        lake.write_table(d, path, fmt)
        r = spark.read.schema("date string, event_rate double").option("header", True).format(fmt).load(path).withColumn("fmt", F.lit(fmt))
        out = r if out is None else out.unionByName(r)
    return out


# ---- filters and null handling ----

KEYS = "ticker, strftime(date, '%Y-%m-%d') AS date"


@query("flt_bars", with_("bars", f"SELECT {KEYS}, round(close, 8) AS close FROM bars WHERE market = 'EUROPE' AND year IN (1995, 1996, 1998) "
                         "AND date BETWEEN DATE '1995-03-01' AND DATE '1998-06-30' AND exchange IN (SELECT DISTINCT n_name FROM nation WHERE n_nationkey % 2 = 1)"))
def _(spark, sf):
    ex = [f"nation_{i}" for i in range(1, 25, 2)]
    d = cl.filter_bars(bars(spark, sf, dims=True), market="europe", exchanges=ex, years=[1995, 1996, 1998], start="1995-03-01", end="1998-06-30")
    return shown(d.select("ticker", "date", "close"), 8)


@query("sel_columns", with_("bars", f"SELECT {KEYS}, round(close, 8) AS close, turnover FROM bars"))
def _(spark, sf):
    return shown(bars(spark, sf).select("ticker", "date", "close", "turnover"), 8)


@query("drop_null_rows", with_("lab", f"SELECT {KEYS}, {sr('futret_5')} AS futret_5 FROM lab WHERE futret_5 IS NOT NULL AND futret_1 IS NOT NULL"))
def _(spark, sf):
    from ..operators.labels import future_return

    d = future_return(future_return(bars(spark, sf), 1), 5)
    return shown(cl.drop_null_rows(d).select("ticker", "date", "futret_5"))


@query("flt_event_abs", with_("lab", f"SELECT {KEYS}, {sr('futret_1')} AS futret_1 FROM lab WHERE abs(futret_1) >= 0.5"))
def _(spark, sf):
    return shown(cl.event_filter(inp.labelled(spark, sf), "futret_1", 0.5).select("ticker", "date", "futret_1"))


GAPS = {"gap3": "CASE WHEN volume % 3 = 0 THEN NULL ELSE close END", "gap7": "CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 4 = 0 AND volume % 2 = 0 THEN NULL ELSE open END"}
step("gaps", "bars", **GAPS)


def gapped(spark, sf):
    return bars(spark, sf).withColumns({k: F.expr(v) for k, v in GAPS.items()})


FF = "last_value({0} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
BF = "first_value({0} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("ffill_zero", with_("gaps", f"SELECT {KEYS}, round(coalesce({FF.format('gap3')}, 0), 8) AS gap3, round(coalesce({FF.format('gap7')}, 0), 8) AS gap7 FROM gaps"))
def _(spark, sf):
    return shown(cl.ffill_zero(gapped(spark, sf), ["gap3", "gap7"]).select("ticker", "date", "gap3", "gap7"), 8)


@query("ffill_bfill_zero", with_("gaps", f"SELECT {KEYS}, round(coalesce({FF.format('gap3')}, {BF.format('gap3')}, 0), 8) AS gap3 FROM gaps"))
def _(spark, sf):
    return shown(cl.ffill_bfill_zero(gapped(spark, sf), ["gap3"]).select("ticker", "date", "gap3"), 8)


@query("inf_to_null", with_("bars", f"SELECT {KEYS}, CASE WHEN volume % 5 IN (0, 1) THEN NULL ELSE round(close, 8) END AS x FROM bars"))
def _(spark, sf):
    x = F.when(F.col("volume") % 5 == 0, float("inf")).when(F.col("volume") % 5 == 1, float("-inf")).otherwise(F.col("close"))
    return shown(cl.inf_to_null(bars(spark, sf).withColumn("x", x), ["x"]).select("ticker", "date", "x"), 8)


@query("ticker_quality", with_("gaps", """SELECT ticker, count(*) AS rows FROM gaps GROUP BY ticker
  HAVING avg((CASE WHEN gap3 IS NULL THEN 1 ELSE 0 END + CASE WHEN gap7 IS NULL THEN 1 ELSE 0 END) / 2) < 0.3 AND count(*) >= 50"""))
def _(spark, sf):
    d = cl.ticker_quality(gapped(spark, sf).select("ticker", "date", "gap3", "gap7"), ["gap3", "gap7"])
    return d.groupBy("ticker").agg(F.count("*").alias("rows"))


ZV = "CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 7 = 2 AND close > open * 0.2 THEN 0 ELSE volume END"


@query("zero_volume_quality", with_("bars", f"""SELECT ticker, count(*) AS rows, CAST(sum(v) AS BIGINT) AS volume FROM (SELECT ticker, {ZV} AS v FROM bars) GROUP BY ticker
  HAVING avg(CASE WHEN v = 0 THEN 1 ELSE 0 END) <= 0.8"""))
def _(spark, sf):
    d = bars(spark, sf).select("ticker", F.expr(ZV).alias("volume"))
    return cl.zero_volume_quality(d).groupBy("ticker").agg(F.count("*").alias("rows"), F.sum("volume").cast("long").alias("volume"))


@query("zero_volume_top", with_("bars", f"""SELECT ticker, count(*) AS rows, CAST(count(*) FILTER (v = 0) AS BIGINT) AS zero_rows, {sr('avg(CASE WHEN v = 0 THEN 1 ELSE 0 END)')} AS zero_ratio
  FROM (SELECT ticker, {ZV} AS v FROM bars) GROUP BY ticker ORDER BY zero_ratio DESC, ticker LIMIT 10"""))
def _(spark, sf):
    d = bars(spark, sf).select("ticker", F.expr(ZV).alias("volume"))
    return shown(cl.zero_volume_shares(d)).orderBy(F.desc("zero_ratio"), "ticker").limit(10)


@query("quick_counts", with_("bars", "SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date FROM bars"))
def _(spark, sf):
    return shown(cl.quick_counts(bars(spark, sf)))


# ---- joins ----

step("preds", "sc", action="CASE WHEN prob >= 0.6 THEN 'LONG' WHEN prob <= 0.2 THEN 'SHORT' ELSE 'FLAT' END")
PREDS = "rn > 3"  # a ticker has no prediction in its first bars


def preds(spark, sf, whole=False):
    p = F.col("prob")
    d = inp.scores(spark, sf).select("ticker", "date", "rn", "prob", F.when(p >= 0.6, "LONG").when(p <= 0.2, "SHORT").otherwise("FLAT").alias("action"))
    return d if whole else d.where("rn > 3").drop("rn")


@query("join_left_panel", with_("preds", f"SELECT b.ticker, strftime(b.date, '%Y-%m-%d') AS date, coalesce(p.prob, 0) AS prob, coalesce(p.action, 'FLAT') AS action "
                                f"FROM bars b LEFT JOIN (SELECT * FROM preds WHERE {PREDS}) p ON b.ticker = p.ticker AND b.date = p.date"))
def _(spark, sf):
    return shown(pn.join_panels(bars(spark, sf).select("ticker", "date"), preds(spark, sf), fill={"prob": 0.0, "action": "FLAT"}))


@query("join_merge3", with_("preds v1", f"SELECT b.ticker, strftime(b.date, '%Y-%m-%d') AS date, round(b.close, 8) AS close, {sr('f.atr14', 4)} AS atr14, p.prob AS pred_prob "
                            f"FROM bars b LEFT JOIN v1 f ON b.ticker = f.ticker AND b.date = f.date LEFT JOIN (SELECT * FROM preds WHERE {PREDS}) p ON b.ticker = p.ticker AND b.date = p.date"))
def _(spark, sf):
    b = bars(spark, sf)
    feats = atr_v1(b).select("ticker", "date", "atr14")
    p = preds(spark, sf).select("ticker", "date", F.col("prob").alias("pred_prob"))
    return shown(pn.join_panels(b.select("ticker", "date", "close"), feats, p), {"close": 8, "atr14": 4})


@query("join_inner_key", with_("bars", f"SELECT a.ticker, n, up, {sr('up / n')} AS share FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) a "
                               "JOIN (SELECT ticker, count(*) AS up FROM bars WHERE close > open GROUP BY ticker) b ON a.ticker = b.ticker"))
def _(spark, sf):
    return shown(pn.rising_share(bars(spark, sf)))


@query("join_inner_date", with_("bars", """SELECT strftime(a.date, '%Y-%m-%d') AS date, a.state AS state_a, b.state AS state_b, CAST(a.state = b.state AS BIGINT) AS same
  FROM (SELECT date, CASE WHEN sum(CASE WHEN close > open THEN 1 ELSE 0 END) * 2 > count(*) THEN 'UP' ELSE 'DOWN' END AS state FROM bars GROUP BY date) a
  JOIN (SELECT date, CASE WHEN sum(CASE WHEN close > open THEN 1 ELSE 0 END) * 2 > count(*) THEN 'UP' ELSE 'DOWN' END AS state FROM bars WHERE market = 'ASIA' GROUP BY date) b ON a.date = b.date"""))
def _(spark, sf):
    b = bars(spark, sf, dims=True)
    return shown(pn.state_agreement(b, b.where(F.col("market") == "ASIA")))


RICH = "SELECT printf('S%09d', s_suppkey) FROM supplier WHERE s_acctbal > 5000"


def rich(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.format_string("S%09d", "s_suppkey").alias("ticker"))


@query("semi_in_list", with_("bars", f"SELECT {KEYS}, round(close, 8) AS close FROM bars WHERE ticker IN ({RICH})"))
def _(spark, sf):
    return shown(pn.in_list(bars(spark, sf).select("ticker", "date", "close"), rich(spark, sf)), 8)


@query("anti_in_list", with_("bars", f"SELECT {KEYS}, round(close, 8) AS close FROM bars WHERE ticker NOT IN ({RICH})"))
def _(spark, sf):
    return shown(pn.in_list(bars(spark, sf).select("ticker", "date", "close"), rich(spark, sf), inside=False), 8)


SECTORS = 10


def sector_map(spark, sf):
    """Each supplier belongs to the sectors of its key and of its nation."""
    s = table(spark, sf, "supplier")
    names = F.array_distinct(F.array(F.concat(F.lit("sector_"), F.col("s_suppkey") % SECTORS), F.concat(F.lit("sector_"), F.col("s_nationkey") % SECTORS)))
    return s.select(F.format_string("S%09d", "s_suppkey").alias("ticker"), F.explode(names).alias("sector"))


@query("sector_join", with_("bars", f"""SELECT sector, count(*) AS rows, count(DISTINCT b.ticker) AS tickers, CAST(sum(CAST(turnover AS DECIMAL(18, 2))) AS DOUBLE) AS turnover FROM bars b JOIN
  (SELECT DISTINCT printf('S%09d', s_suppkey) AS ticker, concat('sector_', unnest([s_suppkey % 10, CAST(s_nationkey % 10 AS BIGINT)])) AS sector FROM supplier) m ON b.ticker = m.ticker GROUP BY sector"""))
def _(spark, sf):
    return shown(pn.sector_summary(bars(spark, sf), sector_map(spark, sf)), 2)


# ---- aggregates ----

@query("agg_event_rate_date", with_("lab", f"SELECT strftime(date, '%Y-%m-%d') AS date, {sr('avg(CASE WHEN label_1d_cls <> 0 THEN 1.0 ELSE 0.0 END)')} AS event_rate FROM lab GROUP BY date"))
def _(spark, sf):
    return shown(pn.class_rates(inp.labelled(spark, sf), "label_1d_cls", {"event_rate": None}))


@query("agg_direction_rate_date", with_("lab", "SELECT strftime(date, '%Y-%m-%d') AS date, " + ", ".join(
    f"{sr(f'avg(CASE WHEN label_1d_cls {op} THEN 1.0 ELSE 0.0 END)')} AS {k}" for k, op in
    (("direction_event_rate", "<> 0"), ("positive_rate", "= 1"), ("negative_rate", "= -1"))) + " FROM lab GROUP BY date"))
def _(spark, sf):
    return shown(pn.class_rates(inp.labelled(spark, sf), "label_1d_cls", {"direction_event_rate": None, "positive_rate": 1, "negative_rate": -1}))


@query("agg_monthly_events", with_("bm", "SELECT strftime(date, '%Y-%m') AS year_month, CAST(sum(big_move_event) AS BIGINT) AS events FROM bm GROUP BY 1"))
def _(spark, sf):
    return inp.big_moves(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("year_month")).agg(F.sum("big_move_event").alias("events"))


@query("agg_summary_ticker", with_("bars", f"SELECT ticker, count(close) AS close_count, {sr('avg(close)', 2)} AS close_mean, {sr('stddev_samp(close)', 2)} AS close_std, "
                                   "round(min(close), 8) AS close_min, round(max(close), 8) AS close_max, " + sr("avg(volume)", 2) + " AS volume_mean, CAST(sum(volume) AS DOUBLE) AS volume_sum FROM bars GROUP BY ticker"))
def _(spark, sf):
    d = pn.summary(bars(spark, sf), {"close": ["count", "mean", "std", "min", "max"], "volume": ["mean", "sum"]})
    return shown(d, {"*": 2, "close_min": 8, "close_max": 8})


@query("agg_event_counts", with_("m002", "SELECT ticker, " + ", ".join(f"CAST(sum({e}) AS BIGINT) AS {e}" for e in EVENTS) + " FROM m002 GROUP BY ticker"))
def _(spark, sf):
    return m002_features(bars(spark, sf)).groupBy("ticker").agg(*[F.sum(e).alias(e) for e in EVENTS])


@query("agg_value_share", with_("preds", f"SELECT action, count(*) AS n, {sr('count(*) / sum(count(*)) OVER ()')} AS share FROM preds GROUP BY action"))
def _(spark, sf):
    return shown(pn.value_share(preds(spark, sf, whole=True), "action"))


@query("agg_zscore_stats", with_("v1", " UNION ALL ".join(
    f"SELECT '{k}' AS feature, {sr(f'avg({k})', 3)} AS mean, {sr(f'stddev_samp({k})', 3)} AS std FROM v1" for k in ("atr5", "atr10", "atr14"))))
def _(spark, sf):
    return shown(sp.zscore_stats(atr_v1(bars(spark, sf)), ["atr5", "atr10", "atr14"]), 3)


cte("dates", "bars", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)")
cte("split", "dates", "SELECT date, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM dates")


@query("agg_class_counts", with_("bm split", "SELECT split, CAST(big_move_event AS BIGINT) AS big_move_event, count(*) AS n FROM bm JOIN split USING (date) GROUP BY ALL"))
def _(spark, sf):
    return shown(sp.class_counts(sp.split_by_date(inp.big_moves(spark, sf)), "big_move_event", ["split"]))


CORR = ["ret_5", "rel", "volume", "turnover", "close"]


@query("corr_matrix", with_("t", f"SELECT a AS feature_a, b AS feature_b, {sr('r', 5)} AS r, {sr('abs(r)', 5)} AS abs_r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM tt" for i, a in enumerate(CORR) for b in CORR[i + 1:]) + ")").replace(
    "\nSELECT a AS", ", tt AS (SELECT ret_5, (high - low) / close AS rel, volume, turnover, close FROM t)\nSELECT a AS"))
def _(spark, sf):
    from ..operators.analytics import corr_matrix
    from ..operators.features import returns

    d = returns(bars(spark, sf)).withColumn("rel", (F.col("high") - F.col("low")) / F.col("close"))
    return shown(corr_matrix(d, CORR), 5)


# ---- sets ----

@query("union_all", with_("bars", "SELECT market, count(*) AS rows FROM (SELECT market FROM bars WHERE market = 'ASIA' UNION ALL SELECT market FROM bars WHERE market IN ('ASIA', 'EUROPE')) GROUP BY market"))
def _(spark, sf):
    b = bars(spark, sf, dims=True)
    d = b.where(F.col("market") == "ASIA").unionByName(b.where(F.col("market").isin("ASIA", "EUROPE")))
    return d.groupBy("market").agg(F.count("*").alias("rows"))


@query("dedupe", "SELECT o_custkey, o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM "
       "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return shown(cl.keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]), 2)


@query("distinct_values", with_("bars", "SELECT 'ticker' AS kind, ticker AS value FROM (SELECT DISTINCT ticker FROM bars) UNION ALL SELECT 'date', strftime(date, '%Y-%m-%d') FROM (SELECT DISTINCT date FROM bars)"))
def _(spark, sf):
    return pn.distinct_values(bars(spark, sf))


@query("ticker_sample", with_("bars", f"SELECT {KEYS}, round(close, 8) AS close FROM bars WHERE ticker IN (SELECT ticker FROM (SELECT DISTINCT ticker FROM bars) ORDER BY md5(ticker || '42'), ticker LIMIT 7)"))
def _(spark, sf):
    return shown(cl.sample_tickers(bars(spark, sf).select("ticker", "date", "close"), 7), 8)


@query("sort_panel", with_("bars", f"SELECT {KEYS}, round(close, 8) AS close FROM bars ORDER BY bars.date, bars.ticker"))
def _(spark, sf):
    return shown(bars(spark, sf).select("ticker", "date", "close").orderBy("date", "ticker"), 8)
