"""Every registered query against its SQL, on whole small tables."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Answers that are rightly empty on the smallest tables.
MAY_BE_EMPTY = {"query_search"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    if key not in ORACLES:
        assert QUERIES[key](spark, SF).count() > 0
        return
    found = differences(spark, con, QUERIES[key], ORACLES[key], SF)
    if key in MAY_BE_EMPTY:
        found = [p for p in found if p != "no rows to compare"]
    assert found == []


def test_entry(spark):
    assert entry.entry(spark).count() == 5
