"""Every registered query of the engine itself against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from docmill.plans import registry
from tests.compare import connection, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name not in registry.ORACLE:
        assert df.count() > 0
        return
    columns, expected = duck_rows(con, registry.ORACLE[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df, columns) == expected


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
