"""The dataset cache after interrupted builds."""

import pytest

from test_panels import make_panel
from tidebar.sources import dataset, lake
from tidebar.sources.dataset import build_dataset


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake") / "bars")
    from pyspark.sql import functions as F

    d = make_panel(spark, {"A": 60, "B": 50})
    d = d.withColumns({"adj_close": F.col("close"), "volume": F.col("volume").cast("long"), "exchange": F.lit("X"), "currency": F.lit("USD"), "market": F.lit("US"), "year": F.year("date")})
    lake.write_lake(d.select(*lake.LAKE_SCHEMA.names), path)
    return path


def test_a_build_that_dies_is_built_again(spark, root, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    plain, options = dataset.write_stats, {"columns": ["ticker", "date", "atr14"], "cache": cache}
    for at in ("before the statistics", "after them"):
        def die(stats, path, at=at):
            if at == "after them":
                plain(stats, path)
            raise OSError(at)

        with monkeypatch.context() as m:
            m.setattr(dataset, "write_stats", die)
            with pytest.raises(OSError, match=at):
                build_dataset(spark, root, **options)
    df, stats = build_dataset(spark, root, **options)
    again, read_back = build_dataset(spark, root, **options)
    assert stats == read_back and "atr14" in stats
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.collect()))


def test_statistics_of_no_scaled_feature(spark, root, tmp_path):
    for normalize in (True, False):
        options = {"columns": ["ticker", "date", "close"], "cache": str(tmp_path / f"cache{normalize}"), "normalize": normalize}
        first = build_dataset(spark, root, **options)
        second = build_dataset(spark, root, **options)
        assert first[1] == second[1] and first[0].count() == second[0].count()
