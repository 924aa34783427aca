"""Every catalogue query against its SQL on the smallest tables."""

import oracle_check
import pytest

import __spark_entry__ as entry
import oracle_queries
from ballotframe.plans.catalogue import CATALOGUE

QUERIES, SQL = CATALOGUE, oracle_queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = oracle_check.duck(sf_dir)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, con, name):
    assert oracle_check.compare(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry_has_rows(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns[:3] == ["view_id", "area", "party"]
    assert df.limit(1).count() == 1
