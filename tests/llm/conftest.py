import os

import pytest
from cases import ODD, SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, with columns whose names operators might use themselves."""
    rows = [(i, t, 1, "x", "y", 2.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, words string, key string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are missing")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
