"""Continuous ingestion of raw bar files into a versioned lake.

Each micro-batch is normalised and replaces the (market, year) partitions it touches; see ``sources.versions``. A bar may
arrive any time late and corrects an earlier one, the lake shows a batch wholly or not at all, and a batch that is run again
after a failure is taken over once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import norm_kr, norm_us
from ..sources.lake import KR_FIELDS, US_FIELDS, write_lake
from ..sources.versions import read_version, replace_bars


def stream_ingest(spark: SparkSession, source: str, lake: str, checkpoint: str, kind: str = "kr", extra: tuple[str, ...] = ("ticker",),
                  max_files: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream. Files hold the raw columns of the kind, then ``extra`` columns that name the ticker (and exchange).
    Short lines end in nulls; a line without a date is no bar. Several streams may write to one lake."""
    fields = [*(KR_FIELDS if kind == "kr" else US_FIELDS), *extra]
    schema = T.StructType([T.StructField(k, T.StringType()) for k in fields])
    reader = spark.readStream.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.csv(source)

    def store(batch: DataFrame, batch_id: int) -> None:
        bars = norm_kr(batch, "ticker") if kind == "kr" else norm_us(batch, "ticker", "exchange" if "exchange" in extra else None)
        replace_bars(batch.sparkSession, lake, bars, stream=checkpoint, batch=batch_id)

    writer = raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def current_lake(spark: SparkSession, lake: str, markets: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """The bars as of now."""
    return read_version(spark, lake, markets, years)


def compact(spark: SparkSession, lake: str, target: str) -> None:
    """Write the current bars as a plain lake partitioned by market and year."""
    write_lake(current_lake(spark, lake), target)
