"""The native operators' queries against their SQL on the smallest tables, and what is registered."""

import os

import pytest

import __spark_entry__ as entry
from barsift.cluster import ship
from barsift.llm import queries
from tests import duck


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert "pipeline" not in entry.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(duck.SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal(spark, name):
    ship(spark)
    got = queries.QUERIES[name](spark, duck.SMALL)
    names, want = duck.rows_of_duck(duck.tables(duck.SMALL), queries.SQL[name])
    assert sorted(got.columns) == names and duck.rows_of_spark(got) == want
