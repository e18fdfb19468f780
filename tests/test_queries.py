"""Every registered query of the library's own plans against its SQL, or at least to the end."""

import pytest
from oracle import SF, compare, connect

from tidepool.plans import aggregates, changes, content, flows, media, registry, relational, requests, scalars, temporal  # noqa: F401


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, con, name):
    compare(spark, con, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql_runs_and_reruns(spark, name):
    query = registry.QUERIES[name]
    one, two = query(spark, SF), query(spark, SF)
    assert one.schema == two.schema
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
