"""Every registered query against its SQL on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, text = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
