"""The driver contract and the SQL oracle at sf0.001."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare, duck

from conftest import SF001


def test_entry(spark):
    df = entry(spark)
    rows = df.collect()
    assert [r["series"] for r in rows] == ["original", "improved", "delta_error"]
    assert set(df.columns) >= {"series", "rmse", "pbias", "cd", "nse"}


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(queries()[name](spark, SF001), con, oracle_sql()[name])
    assert ok, msg
