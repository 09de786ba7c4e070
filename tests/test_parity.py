"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from parity import connect, difference, oracle_rows, spark_rows

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    got = spark_rows(entry.queries()[name](spark, SMALL))
    assert difference(got, oracle_rows(duck, ORACLES[name])) is None
