import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from cadenza.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a DataFrame from a DDL schema and tuples."""
    return lambda schema, *values: spark.createDataFrame(list(values), schema)


@pytest.fixture
def tuples():
    """Sorted tuples of a DataFrame, for comparing with what is expected."""
    def collect(df, *columns):
        found = df.select(*columns) if columns else df
        return sorted(tuple(r) for r in found.collect())
    return collect
