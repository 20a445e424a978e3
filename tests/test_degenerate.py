from __future__ import annotations

import pytest

from tests import degenerate
from tests.oracle import DATA
from wafergrid.plans import compaction

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("kind", degenerate.KINDS)
def test_compaction_queries(spark, tmp_path, kind):
    root = degenerate.make(kind, tmp_path)
    got = sorted(r.file_id for r in compaction.p2_found(spark, root).collect())
    want = [] if kind == "empty" else sorted(r.file_id for r in compaction.p2_found(spark, str(DATA)).collect())
    assert got == want
    assert compaction.p2_compacted_report(spark, root).count() == len({*()} if kind == "empty" else {"heatmaps", "masks", "sam2"})
