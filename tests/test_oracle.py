import pytest

import __spark_entry__ as entry
from tools.compare import connect, difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, sf_small, con, name):
    problem, _ = difference(QUERIES[name](spark, sf_small), con, ORACLES[name])
    assert problem is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6
