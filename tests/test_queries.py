"""Every query runs, and those with SQL agree with DuckDB."""

import pytest

import __spark_entry__ as entry

from .oracle import connect, differs

SQL = entry.oracle_sql()
QUERIES = {k: f for k, f in entry.queries().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in SQL))
def test_agrees_with_sql(spark, con, sf_dir, name):
    assert differs(spark, con, QUERIES[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL))
def test_gives_rows(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) and not got.isna().to_numpy().any()


def test_entry(spark):
    assert entry.entry(spark).columns == ["topic", "rank", "token", "value"]
