"""Every registered query against its SQL in DuckDB on the smallest tables; without SQL it must return rows."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    status, note = compare(spark, con, sf, name, QUERIES, ORACLE)
    assert status in ("ok", "rows-only"), f"{status}: {note}"
    if status == "rows-only":
        assert not note.startswith("0 ")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
