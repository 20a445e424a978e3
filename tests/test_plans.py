"""What the plans of the queries must and must not hold."""

from __future__ import annotations

import pytest

from tests.oracle import DATA
from wafergrid import plans

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
QUERIES = plans.queries()


def plan(spark, name):
    return QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["aupro", "heatmap_evaluation", "image_auc", "best_f1_linspace", "nn_calibrated_auc", "baseline_comparisons", "kfold", "interleave", "run_matrix", "bilinear_resize", "multiscale_max", "violations_grid", "patch_anomaly_auc"])
def test_no_cross_join_and_no_row_by_row_python(spark, name):
    p = plan(spark, name)
    assert not any(x in p for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))


def test_scans_read_what_is_asked(spark):
    p = plan(spark, "image_scores")
    assert "props" not in p and "value" in p
    p = plan(spark, "record_filter")
    assert "EqualTo(label,0)" in p and "In(category" in p
    assert "payload" not in plan(spark, "relative_paths")


@pytest.mark.parametrize("name,never", [("components", "FlatMapGroupsInPandas"), ("region_topk", "FlatMapGroupsInPandas"), ("greedy_coreset", "FlatMapGroupsInPandas"), ("nn_score_sql", "Generate")])
def test_no_task_for_a_whole_bank_or_bucket_of_images(spark, name, never):
    assert never not in plan(spark, name)
