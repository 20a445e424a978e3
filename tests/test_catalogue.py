"""Every query against its SQL, or at least run, on the smallest test data."""

from __future__ import annotations

import pytest

from tests.oracle import DATA, assert_same, connection
from wafergrid import plans

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()
#: Grids that the smallest data leaves incomplete, and graphs and bootstraps that need one.
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(df.collect()) >= 0 and len(set(df.columns)) == len(df.columns)


def test_every_sql_has_a_query():
    assert not set(ORACLE) - set(QUERIES)
