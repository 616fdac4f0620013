"""A lake whose (market, year) partitions are replaced as a whole, in versions that appear at once.

Data files lie under ``data/v=<token>/market=.../year=...`` and are never changed. A manifest, one small JSON file per
version under ``versions/``, lists the folder that holds each live partition. A writer stores the partitions it touches under
a token of its own and then publishes the next manifest by a rename that fails if that version exists. Until the rename a
reader sees the old version, afterwards the new one; a writer that dies before it leaves files that no manifest names. Two
writers that meet both finish: the one that comes second starts again from the version of the first. A read opens one folder
per partition however many versions there were. (The local file system lets a rename replace a file, so there only one
writer at a time is safe; HDFS does not.)

The driver holds the manifest, one entry per market and year.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import LAKE_SCHEMA

KEYS = ["market", "ticker", "date"]


@dataclass
class Manifest:
    """A version: the folder of each (market, year), and the last batch taken over from each stream."""

    version: int = 0
    parts: dict[tuple[str, int], str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        parts = [[m, y, at] for (m, y), at in sorted(self.parts.items())]
        return json.dumps({"version": self.version, "parts": parts, "batches": self.batches})

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], {(m, y): at for m, y, at in d["parts"]}, d["batches"])


class Conflict(RuntimeError):
    """Another writer published this version first."""


class _Files:
    """The few file operations that Spark's readers and writers do not offer, on whatever store the lake is in."""

    def __init__(self, spark: SparkSession, lake: str):
        self.gateway, self.conf = spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.lake, self.fs = lake, self.path(lake).getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.lake}/{folder}")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.lake}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that is either whole or not there; Conflict if it exists."""
        target, hidden = self.path(f"{self.lake}/{name}"), self.path(f"{self.lake}/versions/.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        kind = self.hadoop.Options.Rename
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self.hadoop.FileContext.getFileContext(target.toUri(), self.conf).rename(hidden, target, options)
        except Exception as e:
            self.fs.delete(hidden, False)
            if self.fs.exists(target):
                raise Conflict(name) from e
            raise

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(f"{self.lake}/{name}")).getModificationTime() / 1000

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.lake}/{name}"), True)


def manifest(spark: SparkSession, lake: str, version: int | None = None) -> Manifest:
    """The newest version, or a given one; version 0 is the empty lake."""
    files = _Files(spark, lake)
    found = [int(n[:-5]) for n in files.names("versions") if n.endswith(".json") and not n.startswith(".")]
    number = max(found, default=0) if version is None else version
    return Manifest.from_json(files.read(f"versions/{number:012d}.json")) if number else Manifest()


def read_version(spark: SparkSession, lake: str, markets: list[str] | None = None, years: list[int] | None = None,
                 at: Manifest | None = None) -> DataFrame:
    """The bars of the newest version, or of the manifest given; only folders of the wanted markets and years are opened."""
    at = manifest(spark, lake) if at is None else at
    wanted = None if markets is None else {m.upper() for m in markets}
    folders = [f"{lake}/{p}" for (m, y), p in sorted(at.parts.items()) if (wanted is None or m in wanted) and (years is None or y in years)]
    if not folders:
        return spark.createDataFrame([], LAKE_SCHEMA)
    return spark.read.schema(LAKE_SCHEMA).option("basePath", f"{lake}/data").parquet(*folders).select(*LAKE_SCHEMA.names)


def _stored(files: _Files, df: DataFrame, token: str) -> dict[tuple[str, int], str]:
    """Write bars by market and year under a token, and list the folders made."""
    (df.select(*LAKE_SCHEMA.names).hint("rebalance", "market", "year").sortWithinPartitions("market", "year", "ticker", "date")
     .write.partitionBy("market", "year").parquet(f"{files.lake}/{token}"))
    out = {}
    for m in files.names(token):
        if m.startswith("market="):
            for y in files.names(f"{token}/{m}"):
                out[unquote(m[len("market="):]), int(y[len("year="):])] = f"{token}/{m}/{y}"
    return out


def replace_bars(spark: SparkSession, lake: str, bars: DataFrame, stream: str | None = None, batch: int | None = None, tries: int = 10) -> Manifest:
    """Take over bars, unique per (market, ticker, date): new ones are added, those already there are replaced.

    The bars are stored first, so they are computed once and their partitions are known from the folders. Only these
    partitions are read, merged by an anti join and written again. With ``stream`` and ``batch`` a batch that an earlier
    attempt has published is left out, so a repeated micro-batch changes nothing.
    """
    files, new = _Files(spark, lake), None
    for _ in range(tries):
        old = manifest(spark, lake)
        if stream is not None and old.batches.get(stream, -1) >= batch:
            return old
        token = f"data/v={old.version + 1:012d}-{uuid.uuid4().hex[:12]}"
        if new is None:
            new = _stored(files, bars, token)
        arrived = Manifest(parts=new)
        touched = Manifest(parts={k: old.parts[k] for k in new if k in old.parts})
        written = dict(new)
        if touched.parts:
            fresh = read_version(spark, lake, at=arrived)
            kept = read_version(spark, lake, at=touched).join(fresh.select(*KEYS), KEYS, "left_anti")
            again = {k: p for k, p in new.items() if k in touched.parts}
            both = kept.unionByName(read_version(spark, lake, at=Manifest(parts=again)))
            written |= _stored(files, both, f"{token}-merged")
        nxt = Manifest(old.version + 1, old.parts | written, old.batches | ({stream: batch} if stream is not None else {}))
        try:
            files.publish(f"versions/{nxt.version:012d}.json", nxt.to_json())
        except Conflict:
            continue
        return nxt
    raise Conflict(f"{lake}: {tries} attempts met other writers")


def vacuum(spark: SparkSession, lake: str, keep: int = 2, grace: float = 86_400.0) -> list[str]:
    """Delete the manifests before the last ``keep`` and the data folders that none of these names, and return these folders.
    A folder younger than ``grace`` seconds stays: a writer may be about to publish it."""
    files, newest = _Files(spark, lake), manifest(spark, lake).version
    kept = [manifest(spark, lake, v) for v in range(max(1, newest - keep + 1), newest + 1)]
    named = {p.split("/")[1] for m in kept for p in m.parts.values()}
    gone = []
    for n in files.names("versions"):
        if n.endswith(".json") and int(n[:-5]) <= newest - keep:
            files.drop(f"versions/{n}")
    for n in files.names("data"):
        if n not in named and files.age(f"data/{n}") >= grace:
            files.drop(f"data/{n}")
            gone.append(n)
    return gone
