"""Every registered query against its oracle, and the driver contract."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(con, ORACLES[name], df) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "operational_score" and df.count() > 0
    assert set(ORACLES) <= set(QUERIES)
