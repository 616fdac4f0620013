"""Queries for continuous ingestion into a lake whose partitions are replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import c
from ..sources import lake
from ..sources.versions import manifest, read_version
from ..streaming.ingest import current_lake, stream_ingest
from .q_basic import SILVER_SQL, raw_kr
from .registry import query, shown, with_


def _arrivals(spark, sf, late=None):
    """All first copies arrive, then the later copies, or those of one year. Gives the lake and the version between."""
    source, root, state = (lake.new_folder(spark, k) for k in ("incoming", "stream", "state"))
    raw = raw_kr(spark, sf)
    before = None
    for copy in (0, 1):
        rows = raw.where(c("_copy") == copy)
        if copy and late:
            before, rows = manifest(spark, root), rows.where(F.col("date").startswith(late))
        rows.select(*lake.KR_FIELDS, "ticker").write.mode("append").option("header", True).csv(source)
        stream_ingest(spark, source, root, state).awaitTermination()
    return root, before


@query("stream_ingest", with_("raw_kr", "SELECT " + SILVER_SQL.format(adj="close", turn="turnover", m="KR", ex="CAST(NULL AS VARCHAR)", cur="KRW")
                              + " FROM raw_kr WHERE date IS NOT NULL"))
def _(spark, sf):
    return shown(current_lake(spark, _arrivals(spark, sf)[0]))


@query("stream_correction", with_("bars", """SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS rows, CAST(sum(volume) AS BIGINT) AS volume_before,
  CAST(sum(volume + CASE WHEN close > open AND year(date) = 1996 THEN 1 ELSE 0 END) AS BIGINT) AS volume, CAST(max(CASE WHEN year(date) = 1996 THEN 1 ELSE 0 END) AS BIGINT) AS rewritten
  FROM bars WHERE volume % 13 <> 0 GROUP BY year(date)"""))
def _(spark, sf):
    """Corrections of one year rewrite the folder of that year only; the version before can still be read."""
    root, before = _arrivals(spark, sf, "1996")
    now = manifest(spark, root)
    changed = [k[1] for k, folder in now.parts.items() if before.parts.get(k) != folder]
    old = read_version(spark, root, at=before).groupBy("year").agg(F.sum("volume").alias("volume_before"))
    new = current_lake(spark, root).groupBy("year").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))
    return shown(new.join(old, "year").withColumn("rewritten", c("year").isin(changed)))
