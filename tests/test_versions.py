"""The versioned lake and the stream that feeds it: replacement, crashes, two writers, clean-up."""

import datetime as dt

import pytest

from tidebar.sources import lake, versions
from tidebar.streaming.ingest import compact, current_lake, stream_ingest

HEAD = "date,open,high,low,close,volume,value,ticker\n"


def arrive(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD + "".join(f"{d},{x},{x},{x},{x},10,10,{t}\n" for d, x, t in rows))


@pytest.fixture
def places(tmp_path):
    return tmp_path / "src", str(tmp_path / "lake"), str(tmp_path / "state")


def closes(spark, root):
    return {(r["ticker"], r["date"].isoformat()): r["close"] for r in current_lake(spark, root).collect()}


def test_a_late_correction_rewrites_its_partition_only(spark, places, tmp_path):
    src, root, state = places
    assert current_lake(spark, root).count() == 0 and current_lake(spark, root).schema == lake.LAKE_SCHEMA
    arrive(src, "a.csv", ("20200102", 1, "A"), ("20200103", 1, "A"), ("20190104", 4, "B"), ("n.a.", 9, "A"))
    stream_ingest(spark, str(src), root, state).awaitTermination()
    first = versions.manifest(spark, root)
    arrive(src, "b.csv", ("20200102", 2, "A"), ("20210105", 5, "A"))
    stream_ingest(spark, str(src), root, state).awaitTermination()
    second = versions.manifest(spark, root)
    assert closes(spark, root) == {("A", "2020-01-02"): 2.0, ("A", "2020-01-03"): 1.0, ("B", "2019-01-04"): 4.0, ("A", "2021-01-05"): 5.0}
    assert first.parts["KR", 2019] == second.parts["KR", 2019] and first.parts["KR", 2020] != second.parts["KR", 2020]
    assert versions.read_version(spark, root, at=first).count() == 3  # the version before stays readable
    assert current_lake(spark, root, ["kr"], [2020]).count() == 2 and current_lake(spark, root, ["US"]).count() == 0
    compact(spark, root, str(tmp_path / "flat"))
    assert lake.scan_lake(spark, str(tmp_path / "flat")).count() == 4


def test_a_crash_before_the_switch_leaves_the_old_version(spark, places, monkeypatch):
    src, root, state = places
    arrive(src, "a.csv", ("20200102", 1, "A"))
    stream_ingest(spark, str(src), root, state).awaitTermination()
    before = closes(spark, root)
    arrive(src, "b.csv", ("20200102", 2, "A"))

    def die(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(versions._Files, "publish", die)
        with pytest.raises(Exception, match="killed"):
            stream_ingest(spark, str(src), root, state).awaitTermination()
    assert closes(spark, root) == before and versions.manifest(spark, root).version == 1
    stream_ingest(spark, str(src), root, state).awaitTermination()  # the same batch again
    assert closes(spark, root) == {("A", "2020-01-02"): 2.0} and versions.manifest(spark, root).version == 2


def test_a_batch_published_before_the_crash_is_not_taken_twice(spark, places):
    _, root, _ = places
    bars = spark.createDataFrame([(dt.date(2020, 1, 2), *[1.0] * 5, 10, 10.0, "A", None, "KRW", "KR", 2020)], lake.LAKE_SCHEMA)
    assert versions.replace_bars(spark, root, bars, "s", 0).version == 1
    assert versions.replace_bars(spark, root, bars, "s", 0).version == 1
    assert versions.replace_bars(spark, root, bars.limit(0), "s", 1).version == 2  # nothing new is a version too
    assert current_lake(spark, root).count() == 1


def test_two_writers_that_meet_both_finish(spark, places, monkeypatch):
    _, root, _ = places
    schema = lake.LAKE_SCHEMA

    def bars(ticker, close):
        return spark.createDataFrame([(dt.date(2020, 1, 2), *[close] * 5, 10, 10.0, ticker, None, "KRW", "KR", 2020)], schema)

    plain, met = versions._Files.publish, []

    def publish(self, name, text):
        if not met:
            met.append(name)
            versions.replace_bars(spark, root, bars("B", 2.0))  # another writer is faster
        plain(self, name, text)

    monkeypatch.setattr(versions._Files, "publish", publish)
    assert versions.replace_bars(spark, root, bars("A", 1.0)).version == 2
    assert closes(spark, root) == {("A", "2020-01-02"): 1.0, ("B", "2020-01-02"): 2.0}


def test_reads_and_clean_up_after_many_batches(spark, places):
    _, root, _ = places
    for k in range(12):
        row = (dt.date(2020, 1, 1 + k), *[float(k)] * 5, 10, 10.0, "A", None, "KRW", "KR", 2020)
        versions.replace_bars(spark, root, spark.createDataFrame([row], lake.LAKE_SCHEMA).coalesce(1), "s", k)
    df = current_lake(spark, root)
    assert df.count() == 12 and len({f.rsplit("/", 1)[0] for f in df.inputFiles()}) == 1  # one folder per live partition
    assert len(df.inputFiles()) <= 2
    assert versions.vacuum(spark, root) == []  # all folders are young
    gone = versions.vacuum(spark, root, keep=1, grace=0)
    assert len(gone) >= 11 and current_lake(spark, root).count() == 12
    assert versions.replace_bars(spark, root, df.limit(0), "s", 99).version == 13
