"""Every named query against its check SQL; set QUERY_FOLDER for larger tables."""

import os

import pytest
from compare import difference, tables_of

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("QUERY_FOLDER", "/root/testdata/sf0.001")
CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def base():
    return tables_of(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, base, name):
    found = queries()[name](spark, FOLDER).toPandas()
    if name in CHECKS:
        assert difference(found, base.sql(CHECKS[name]).df()) is None
    else:
        assert len(found) > 0


def test_entry_runs(spark):
    assert entry(spark).columns == ["query_id", "song_id", "similarity", "rank"]
