"""Every registered query against its SQL text; queries without one must return rows."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_names_match():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name in SQL:
        assert compare(got, con.sql(SQL[name]).to_arrow_table()) is None
    else:
        assert got.num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
