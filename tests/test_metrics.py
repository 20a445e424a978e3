from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafergrid.operators import cumulative, grids, masks, metrics
from wafergrid.operators.cumulative import running_totals
from wafergrid.session import written


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_auc_of_separated_classes_and_single_class(spark):
    df = rows(spark, [("a", 0, 0.1), ("a", 0, 0.2), ("a", 1, 0.8), ("a", 1, 0.9), ("b", 1, 0.5)], "g string, y int, s double")
    assert {r.g: r.auc for r in metrics.roc_auc(df, ["g"], "y", "s").collect()} == {"a": 1.0, "b": None}


def test_auc_with_ties_nulls_and_nan_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 10
    df = rows(spark, [(int(a), float(b)) for a, b in zip(y, s)] + [(None, 0.5), (1, None), (0, math.nan)], "y int, s double")
    want = np.mean([(p > n) + (p == n) / 2 for p in s[y == 1] for n in s[y == 0]])
    assert metrics.roc_auc(df, [], "y", "s").first().auc == pytest.approx(want)


def test_auc_without_rows(spark):
    assert metrics.roc_auc(rows(spark, [], "g string, y int, s double"), ["g"], "y", "s").collect() == []


def test_average_ranks(spark):
    df = rows(spark, [(0.1,), (0.2,), (0.2,), (0.3,)], "s double")
    assert {r.s: r.avg_rank for r in metrics.average_ranks(df, [], "s").collect()} == {0.1: 1.0, 0.2: 2.5, 0.3: 4.0}


def test_best_f1_takes_the_highest_of_equal_thresholds(spark):
    df = rows(spark, [(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8)], "y int, s double")
    r = metrics.best_f1(df, [], "y", "s").first()
    assert (r.f1, r.iou) == (1.0, 1.0) and r.threshold == 0.8


def test_bounded_thresholds(spark):
    df = rows(spark, [(0, 0.0), (0, 0.25), (1, 0.75), (1, 1.0)], "y int, s double")
    r = metrics.best_f1(df, [], "y", "s", 3).first()
    assert r.n_thresholds == 3 and r.f1 >= 0.8


def test_no_positive_gives_zero(spark):
    r = metrics.best_f1(rows(spark, [(0, 0.5), (0, 0.7)], "y int, s double"), [], "y", "s").first()
    assert (r.f1, r.iou) == (0.0, 0.0)


def _square(spark, extra=None):
    cells = [("i", x, y, 1 if 1 <= x <= 2 and 1 <= y <= 2 else 0) for y in range(4) for x in range(4)]
    return rows(spark, [(i, x, y, t, 0.9 if t else (0.95 if extra and y == 0 else 0.1)) for i, x, y, t in cells], "img string, x int, y int, target int, score double")


@pytest.mark.parametrize("extra,low,high", [(None, 1.0, 1.0), (True, 0.0, 0.5)])
def test_region_overlap(spark, extra, low, high):
    px = _square(spark, extra)
    region = grids.components(px.where("target = 1"), "img").withColumnRenamed("component", "region")
    r = metrics.region_overlap_score(px, region, "img", "score", "target").first()
    assert r.n_regions == 1 and low <= round(r.aupro, 9) <= high


def test_region_overlap_without_regions(spark):
    px = _square(spark).withColumn("target", F.lit(0))
    region = grids.components(px.where("target = 1"), "img").withColumnRenamed("component", "region")
    assert metrics.region_overlap_score(px, region, "img", "score", "target").first().aupro is None


def test_confusion_of_empty_masks_is_one_and_micro_is_zero(spark):
    per = metrics.confusion(rows(spark, [("a", 0, 0), ("a", None, 0)], "img string, p int, t int").withColumn("label", F.lit(0)), ["img", "label"], "p", "t")
    r = per.first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1, r.iou) == (0, 0, 0, 1.0, 1.0, 1.0, 1.0)
    s = metrics.summarize_confusion(per, [], "label").first()
    assert s.micro_f1 == 0.0 and s.mean_f1 == 1.0 and s.mean_anomaly_f1 is None


def test_micro_is_of_summed_counts(spark):
    per = rows(spark, [("c", 1, 1, 0, 1), ("c", 1, 9, 3, 0)], "g string, label int, tp long, fp long, fn long").select("*", *metrics.ratios("tp", "fp", "fn", empty=1.0))
    s = metrics.summarize_confusion(per, ["g"], "label").first()
    assert s.micro_precision == pytest.approx(10 / 13) and s.mean_recall == pytest.approx(0.75)


def test_calibration(spark):
    df = rows(spark, [(v,) for v in (0.0, 1.0, 2.0, 3.0, None, math.nan)], "s double")
    assert metrics.normal_threshold(df, [], "s", 0.5).first().threshold == 1.5
    with pytest.raises(ValueError):
        metrics.normal_threshold(df, [], "s", 1.0)
    bad = rows(spark, [(0, "val"), (1, "val"), (0, "test"), (None, "val")], "label int, split string")
    assert metrics.not_calibratable(bad, "label", "split").count() == 3


def test_proposal_differs_from_prediction_only_at_or_below_zero(spark):
    df = rows(spark, [(s, t) for s in (-1.0, 0.0, 1.0) for t in (-0.5, 0.0, 0.5)], "s double, t double").select("s", "t", masks.proposal(F.col("s"), F.col("t")).alias("a"), masks.predicted(F.col("s"), F.col("t")).alias("b"))
    assert {(r.s, r.t) for r in df.where("a <> b").collect()} == {(0.0, -0.5), (0.0, 0.0)}


def test_agreement_of_empty_masks(spark):
    df = rows(spark, [("none", 0, 0), ("second", 0, 1), ("first", 1, 0)], "g string, a int, b int")
    r = {x.g: (x.iou, x.expansion) for x in masks.agreement(df, ["g"], "a", "b").collect()}
    assert r == {"none": (1.0, 1.0), "second": (0.0, math.inf), "first": (0.0, 0.0)}


def test_fusion_modes(spark):
    df = rows(spark, [("g", 1, 1), ("g", 1, 0), ("g", 0, 1), ("g", 0, 0)], "g string, a int, b int")
    for mode, want in (("intersection", 1), ("union", 3), ("first", 2), ("second", 2), ("selective", 1)):
        assert masks.fused(df, ["g"], "a", "b", mode).agg(F.sum("fused")).first()[0] == want
    with pytest.raises(ValueError):
        masks.fused(df, ["g"], "a", "b", "other")


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_totals(spark, n):
    df = rows(spark, [("a" if i % 3 else "b", i, i % 7) for i in range(n)], "g string, o int, v int")
    got = {(r.g, r.o): r.v_upto for r in running_totals(df, ["g"], "o", ["v"]).collect()}
    assert got == {("a" if i % 3 else "b", i): sum(j % 7 for j in range(i + 1) if bool(j % 3) == bool(i % 3)) for i in range(n)}


def test_null_groups_stay(spark):
    df = rows(spark, [(None, 0, 0.1), (None, 1, 0.9), ("a", 1, 0.5), ("a", 0, 0.6)], "g string, y int, s double")
    assert {r.g: r.auc for r in metrics.roc_auc(df, ["g"], "y", "s").collect()} == {None: 1.0, "a": 0.0}
    assert {r.g: r.f1 for r in metrics.best_f1(df, ["g"], "y", "s").collect()} == {None: 1.0, "a": pytest.approx(2 / 3)}
    assert {r.g: r.q0 for r in metrics.exact_quantiles(df, ["g"], "s", [0.5]).collect()} == {None: 0.5, "a": 0.55}


@pytest.mark.parametrize("q", [0.0, 1 / 3, 0.5, 0.995, 1.0])
def test_exact_quantiles_equal_numpy(spark, q):
    v = np.random.default_rng(9).integers(0, 60, 400) / 7
    got = metrics.exact_quantiles(rows(spark, [(float(x),) for x in v], "v double"), [], "v", [q]).first()
    assert got.n == 400 and got.q0 == pytest.approx(np.quantile(v, q))


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_running_totals_of_a_hot_group_and_of_text(spark, coalesced, monkeypatch):
    """In one range, and in as many as the session's shuffles have."""
    n, ranges = 30_000, []
    monkeypatch.setattr(cumulative, "written", lambda df, name: ranges.append(written(df, name)) or ranges[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), F.format_string("%08d", F.col("id") * 7919 % 30_011).alias("o"), F.lit(1).alias("v"))
    try:
        got = running_totals(df, ["g"], "o", ["v"], descending=True)
        found = {r.o: r.v_upto for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    if coalesced == "false":
        pieces = ranges[0].where("g = 'hot'").select("__piece").distinct().count()
        assert pieces > 1  # a hot group is several tasks
    order = sorted(((f"{i * 7919 % 30_011:08d}", "cold" if i % 3 == 0 else "hot") for i in range(n)), reverse=True)
    seen, want = {"cold": 0, "hot": 0}, {}
    for o, g in order:
        seen[g] += 1
        want[o] = seen[g]
    assert found == want


def test_components_of_images_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = np.random.default_rng(1)
        cells = [(f"i{k % 5}", int(x), int(y)) for k, (x, y) in enumerate(rng.integers(0, 16, (800, 2)))] + [(None, 1, 1), ("i0", None, 1)]
        got = grids.components(rows(spark, cells, "img string, x int, y int"), "img").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    there: dict[str, set] = {}
    for i, x, y in cells:
        if i is not None and x is not None:
            there.setdefault(i, set()).add((y, x))
    want = {}
    for i, some in there.items():
        left = set(some)
        while left:
            first = min(left)
            todo, part = [first], set()
            while todo:
                y, x = todo.pop()
                if (y, x) in left:
                    left.discard((y, x))
                    part.add((y, x))
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            want |= {(i, x, y): min(part)[0] << 20 | min(part)[1] for y, x in part}
    assert {(r.img, r.x, r.y): r.component for r in got} == want and len(got) == len(want)
