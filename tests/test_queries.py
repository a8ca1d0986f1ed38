"""Every query of the catalogue against its SQL."""

import __spark_entry__ as entry
import pytest

from compare import both, connection
from slideframe import deck_queries, queries  # noqa: F401  (the first adds to the second)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    ours, theirs = both(spark, SF, con, queries.QUERIES[name], queries.SQL[name])
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) == set(queries.SQL)
