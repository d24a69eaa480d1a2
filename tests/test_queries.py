"""Every registered query against its SQL on the smallest tables."""

import pytest
from parity import compare, connect

from shoptally.plans import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_same_as_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, FOLDER, all_queries()[name])
    assert verdict.startswith(("same", "rows only")), verdict
