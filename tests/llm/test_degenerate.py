from __future__ import annotations

import pytest

from tests import degenerate
from tests.oracle import DATA, cell
from wafergrid.llm import queries

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
#: The rows of these follow the rows given, which are other ones with NULL and repeated rows in them; they must run.
FOLLOW = {"p6_ids", "p7_packed", "p7_container_report", "p8_found", "p8_levels", "p8_level_profile", "p8_heldout_accuracy", "p5_overlap_report"}


@pytest.fixture(scope="module", params=degenerate.KINDS)
def case(request, tmp_path_factory):
    return request.param, degenerate.make(request.param, tmp_path_factory.mktemp(request.param))


def rows(df):
    return sorted(str([cell(x) for x in r]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, case, name):
    kind, root = case
    got = rows(queries.QUERIES[name](spark, root))
    if kind == "empty":
        assert got == [] or name in ("p7_container_report",)
    elif kind == "clashes" or name not in FOLLOW:
        assert got == rows(queries.QUERIES[name](spark, str(DATA)))
