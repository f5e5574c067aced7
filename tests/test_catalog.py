"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

from workloads.catalog import ORACLES, QUERIES
from workloads.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert differences(spark, duck, name, QUERIES[name], ORACLES[name], SF) is None
