"""Every registered query beside its SQL twin, exactly."""

import pytest
from check_oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, sf, name):
    assert compare(con, spark, sf, name, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_without_sql_gives_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["policy_version", "portfolio", "risk_bucket", "rwa_amount"]
    assert df.count() == 35
