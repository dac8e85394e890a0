import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedwright.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("feedwright-tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame('a string, b int', (x, 1), ...)"""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def rows(df, *order):
    cols = order or df.columns
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
