"""Every registered query against its SQL in DuckDB on the smallest tables; the others must give rows."""

import os

import pytest

from foliant.plans import registry
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_sql_keys_are_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    if name in registry.SQL:
        assert compare(df, con, registry.SQL[name]) == []
    else:
        assert df.count() > 0
    spark.catalog.clearCache()
