"""Registered queries against their oracle SQL on the smallest tables."""

import pytest

from oracle import compare, connect
from spanloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    if name in ORACLES:
        problems, _, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
        assert not problems
    else:
        assert QUERIES[name](spark, SF).columns
