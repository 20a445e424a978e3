"""The subpackage's queries against their SQL, or at least run, on the smallest test data."""

from __future__ import annotations

import pytest

from tests.oracle import DATA, assert_same, connection
from wafergrid.llm import queries

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert len(df.collect()) >= 0 and len(set(df.columns)) == len(df.columns)
