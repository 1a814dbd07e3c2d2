"""Every query that SQL can express, value by value, on the generated tables."""

import pytest
from check_oracle import compare, connect
from conftest import TESTDATA

from fareloom.plans.catalog import all_queries
from fareloom.plans.oracle import all_sql


@pytest.fixture(scope="module")
def con():
    return connect(TESTDATA)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_as_sql(spark, con, name):
    problem, _, _ = compare(spark, TESTDATA, name, con)
    assert problem is None


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
