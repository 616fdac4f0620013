"""Files in and out: raw CSV trees, the partitioned lake, cached datasets, documents."""

from __future__ import annotations

import csv
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import filter_bars, norm_kr, norm_us, sample_tickers
from ..operators.ordered import shared_folder

KR_FIELDS = ["date", "open", "high", "low", "close", "volume", "value"]
US_FIELDS = ["Date", "Low", "Open", "Volume", "High", "Close", "Adjusted Close"]
META_STEMS = ["code", "readme"]
LAKE_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), *[T.StructField(k, T.DoubleType()) for k in ("open", "high", "low", "close", "adj_close")],
    T.StructField("volume", T.LongType()), T.StructField("turnover", T.DoubleType()),
    *[T.StructField(k, T.StringType()) for k in ("ticker", "exchange", "currency", "market")], T.StructField("year", T.IntegerType()),
])


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


CSV_FILES = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}


def csv_headers(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The CSV files under some folders by their header; files without one are under the empty header. Tasks look for the first
    lines, as a tree may have very many small files; of a large file they read its first split."""
    lines = (spark.read.options(**CSV_FILES).text(paths).where("_metadata.file_block_start = 0")
             .select("value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.monotonically_increasing_id().alias("at")))
    out: dict[tuple[str, ...], list[str]] = {}
    for path, line in sorted(map(tuple, lines.groupBy("path").agg(F.min_by("value", "at")).collect())):
        names = tuple(x.strip() for x in next(csv.reader([line.lstrip("\ufeff")]), []))
        out.setdefault(names, []).append(path)
    return out


def read_raw_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw CSV files with every column as text. Columns go by the header of their own file: files with equal headers are read
    together and the groups are united by name. A line with fewer fields than its header ends in nulls, one with more loses
    the rest; both keep their text in ``_malformed``, which ``malformed_counts`` counts. Input splits take the place of batches."""
    out, headers = None, csv_headers(spark, paths)
    for names, files in headers.items():
        if not names:
            continue
        schema = T.StructType([T.StructField(k, T.StringType()) for k in [*names, "_malformed"]])
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").schema(schema)
        # folders are listed by tasks; a list of files is looked up on the driver
        part = reader.options(**CSV_FILES).csv(paths) if len(headers) == 1 else reader.csv(files)
        part = part.withColumn("_path", F.col("_metadata.file_path"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no CSV file with a header under {paths}")
    return out


def malformed_counts(raw: DataFrame) -> DataFrame:
    """Lines per file, and how many of them have more or fewer fields than the header."""
    fields = [k for k in raw.columns if not k.startswith("_")]  # a line is only checked for the columns that are read
    odd = F.col("_malformed").isNotNull() & (F.length(F.concat_ws("", *fields)) >= 0)
    return raw.groupBy("_path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(odd).alias("malformed"))


def _from_path(pattern: str):
    """A part of the file path as it was written: paths come with escapes, in which a plus sign stands for itself."""
    return F.upper(F.trim(F.regexp_extract(F.url_decode(F.replace(F.col("_path"), F.lit("+"), F.lit("%2B"))), pattern, 1)))


def ingest_tree(spark: SparkSession, kr_root: str | None = None, us_root: str | None = None,
                ticker_pattern: str = r"([^/]+)\.csv$", exchange_pattern: str = r"([^/]+)/csv/(?:[^/]+/)*[^/]+\.csv$",
                exchange_priority: tuple[str, ...] = ("NASDAQ", "NYSE", "SP500", "FORBES2000")) -> DataFrame:
    """All bars under the two file trees in one job. The ticker comes from the file name, the exchange from the folder that
    holds its ``csv`` folder; meta files are skipped. A ticker listed on several exchanges keeps the bar of the first exchange in the priority."""
    parts = []
    ticker = _from_path(ticker_pattern)
    if kr_root:
        raw = read_raw_csv(spark, kr_root).withColumn("ticker", ticker)
        parts.append(norm_kr(raw.where(~F.lower("ticker").isin(META_STEMS)), "ticker", seq="_path"))
    if us_root:
        raw = read_raw_csv(spark, us_root).withColumns({
            "ticker": ticker, "exchange": _from_path(exchange_pattern)})
        rank = F.lit(0)
        for i, e in enumerate(reversed(exchange_priority)):
            rank = F.when(F.col("exchange") == e, i + 1).otherwise(rank)
        raw = raw.where(~F.lower("ticker").isin(META_STEMS)).withColumn("_rank", rank)
        parts.append(norm_us(raw, "ticker", "exchange", seq="_rank"))
    if not parts:
        raise ValueError("no input folder given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_lake(df: DataFrame, root: str) -> None:
    """Write bars by market and year, replacing only the partitions present in ``df``.

    Ticker stays a sorted column: as a folder level it would make a file per ticker and year. Rows are rebalanced by market
    and year at run time, so a small market-year is one file and a large one is split over tasks and files.
    """
    (df.hint("rebalance", "market", "year").sortWithinPartitions("market", "year", "ticker", "date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market", "year").parquet(root))


def scan_lake(spark: SparkSession, root: str) -> DataFrame:
    """The lake with typed partition columns; filters on market and year skip whole folders."""
    return spark.read.schema(LAKE_SCHEMA).parquet(root)


def load_silver(spark: SparkSession, root: str, market=None, exchanges=None, tickers=None, years=None, start=None, end=None,
                max_tickers=None, columns=None) -> DataFrame:
    df = filter_bars(scan_lake(spark, root), market, exchanges, tickers, years, start, end)
    df = sample_tickers(df, max_tickers)
    return df.select(*columns) if columns else df


def lake_version(spark: SparkSession, root: str) -> str:
    """A hash of the lake's files: path, length and time of each. No data is read, and deleted files change it too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    lines = []
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().endswith(".parquet"):
            lines.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()


def dataset_key(params: dict, version: str) -> str:
    """SHA-256 of the canonical parameters and the lake version."""
    return hashlib.sha256(json.dumps({**params, "_version": version}, sort_keys=True, default=str).encode()).hexdigest()


def cached_dataset(spark: SparkSession, folder: str, params: dict, version: str, build, refresh: bool = False) -> DataFrame:
    """Read the dataset stored under the key of its parameters, or build and store it. ``refresh`` rebuilds and stores."""
    path = f"{folder}/{dataset_key(params, version)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if refresh or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Store (feature, mean, std) rows as one JSON document, the size of the feature list."""
    doc = stats.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("mean", "std"))))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def stats_source(spark: SparkSession, path: str) -> DataFrame:
    """Read normalization statistics; a deviation of about 0 becomes 1."""
    stats = F.from_json("value", "map<string, struct<mean: double, std: double>>")
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(stats).alias("feature", "s"))
    return rows.select("feature", "s.mean", F.when(F.abs("s.std") > 1e-12, F.col("s.std")).otherwise(1.0).alias("std"))


STATS = "map<string, struct<mean: double, std: double, min: double, max: double, start: double, end: double>>"
SIGNALS = "map<string, struct<active_periods: double, max_intensity: double, avg_intensity: double>>"
EPISODE_FIELDS = {
    "episode_id": "bigint", "ticker": "string", "event_type": "string", "episode_label": "string", "start_date": "string", "end_date": "string",
    "duration_days": "bigint", "price_change_pct": "double", "max_price_range_pct": "double", "data_points": "bigint",
    "feature_statistics": STATS, "event_signals": SIGNALS, "mode": "string",
}


def episodes_source(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Episodes from JSON lines, or from one nested document with an ``episodes`` list. A document is read by one task, so
    only lines suit a large table."""
    if document:
        one = ", ".join(f"{k}: {t}" for k, t in EPISODE_FIELDS.items())
        df = spark.read.schema(f"episodes array<struct<{one}>>").option("multiLine", True).json(path)
        df = df.select(F.explode("episodes").alias("e")).select("e.*")
    else:
        df = spark.read.schema(", ".join(f"{k} {t}" for k, t in EPISODE_FIELDS.items())).json(path)
    return df.withColumns({k: F.to_date(k) for k in ("start_date", "end_date")}).drop("mode")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    out = df.write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.json(path)
