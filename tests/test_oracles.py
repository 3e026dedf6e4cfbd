"""Every query of the screening engine against its SQL on the smallest tables."""

import os

import pytest

import barsift.path_queries  # noqa: F401  (registers more)
from barsift import queries
from barsift.cluster import ship
from tests import duck

pytestmark = pytest.mark.skipif(not os.path.isdir(duck.SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck.tables(duck.SMALL)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal(spark, con, name):
    ship(spark)
    got = queries.QUERIES[name](spark, duck.SMALL)
    names, want = duck.rows_of_duck(con, queries.SQL[name])
    assert sorted(got.columns) == names
    assert duck.rows_of_spark(got) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    ship(spark)
    assert queries.QUERIES[name](spark, duck.SMALL).count() > 0
