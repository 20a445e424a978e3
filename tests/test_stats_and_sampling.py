from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tests.oracle import DATA
from wafergrid.operators import joins, lineage, sampling, stats
from wafergrid.plans import contract_queries


def test_bootstrap_regression():
    mean, low, high = stats.bootstrap_mean(np.array([0.1, 0.4, 0.9, 1.6]), 0.8, 12, 42)
    assert (mean, low, high) == pytest.approx((0.75, 0.675, 1.125))


@pytest.mark.parametrize("bad", [{"confidence": 1.0}, {"samples": 0}])
def test_bootstrap_options(bad):
    with pytest.raises(ValueError):
        stats.bootstrap_mean(np.array([1.0]), **bad)


def test_bootstrap_refuses_no_values():
    with pytest.raises(ValueError):
        stats.bootstrap_mean(np.array([]))


def test_constant_deltas_have_no_width(spark):
    df = spark.createDataFrame([("g", i, b, b + 0.1) for i, b in enumerate((0.1, 0.3, 0.5))] + [("g", 9, None, 0.2)], "g string, i int, a double, b double")
    r = stats.paired_bootstrap(df, ["g"], ["i"], "a", "b", samples=50).first()
    assert r.n == 3 and (r.mean, r.ci_low, r.ci_high) == pytest.approx((0.1, 0.1, 0.1))


def _cells(spark, drop=0, twice=False):
    rows = [("c", k, s, i, 0.5, 0.5 + (0.2 if i == "a" else -0.1)) for k in (1, 2) for s in (7, 8) for i in ("a", "b")]
    rows = rows[drop:] + (rows[-1:] if twice else [])
    return spark.createDataFrame([("x", *r) for r in rows], "cmp string, category string, k int, seed int, sample_id string, a double, b double")


KEYS = {"category": "category", "shot": "k", "seed": "seed", "sample": "sample_id", "baseline": "a", "candidate": "b"}


def test_repeated_measures(spark):
    r = stats.clustered_bootstrap(_cells(spark), ["cmp"], **KEYS, samples=64).first()
    assert (r.mean_delta, r.seed_std, r.n_rows, r.n_images) == (pytest.approx(0.05), pytest.approx(0), 8, 2)
    assert r.ci_low <= r.mean_delta <= r.ci_high


def test_comparisons_hold_sums_of_images(spark):
    """All metrics and levels against the replicates of whole cubes; what a comparison gathers is a row an image, without its cells."""
    rng = np.random.default_rng(2)
    rows = [(c, k, s, i, *rng.random(4).tolist(), None if i == 0 else "ab"[i % 2]) for c, n in (("p", 5), ("o", 3)) for i in range(n) for k in (4, 1, 2) for s in (9, 7)]
    df = spark.createDataFrame(rows, "category string, k int, seed int, sample_id int, a double, b double, c double, d double, stratum string")
    scopes, metrics = {n: F.col(n) for n in ("k", "category", "stratum")}, {"f1": ("a", "b"), "iou": ("c", "d")}
    out = stats.comparison_intervals(df, scopes, metrics, category="category", shot="k", seed="seed", sample="sample_id", samples=300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow", plan.index("FlatMapGroupsInArrow") + 20)
    pdf = df.toPandas()
    levels = [("overall", "all", pdf), *[(n, str(v), part) for n in scopes for v, part in pdf.groupby(n)]]
    want = {}
    for m, (x, y) in metrics.items():
        for scope, level, part in levels:
            cubes = []
            for _, own in sorted(part.assign(v=part[y] - part[x]).groupby("category"), key=lambda g: g[0]):
                cubes.append(own.pivot(index=["k", "seed"], columns="sample_id", values="v").to_numpy().reshape(part.k.nunique(), part.seed.nunique(), -1))
            draw, means = np.random.default_rng(4880), []
            for a in range(0, 300, 256):
                b = min(256, 300 - a)
                seeds = draw.integers(0, part.seed.nunique(), size=(b, part.seed.nunique()))
                images = [draw.integers(0, c.shape[2], size=(b, c.shape[2])) for c in cubes]
                means += [np.mean([c[:, seeds[r]][:, :, i[r]].mean() for c, i in zip(cubes, images)]) for r in range(b)]
            std = np.mean([c.mean(axis=2) for c in cubes], axis=(0, 1)).std(ddof=1)
            want[m, scope, level] = (np.mean([c.mean() for c in cubes]), *np.percentile(means, [2.5, 97.5]), std, len(part), sum(c.shape[2] for c in cubes))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_comparisons_take_rows_in_batches(spark):
    """As in one batch, though categories and images come in any order; a grid is refused also where its gap lies between batches."""
    rng = np.random.default_rng(5)
    rows = [(c, k, s, i, *rng.random(2).tolist()) for c in ("q", "p") for i in range(9) for k in (1, 2) for s in (7, 8)]
    df = spark.createDataFrame(rows, "category string, k int, seed int, sample_id int, a double, b double")
    options = {"category": "category", "shot": "k", "seed": "seed", "sample": "sample_id", "samples": 300}
    found = lambda d: sorted(map(tuple, stats.comparison_intervals(d, {"k": F.col("k")}, {"m": ("a", "b")}, **options).collect()))
    want = found(df)
    given = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        out = stats.comparison_intervals(df, {}, {"m": ("a", "b")}, **options)
        assert out._jdf.queryExecution().analyzed().child().functionExpr().evalType() == PythonEvalType.SQL_GROUPED_MAP_ARROW_ITER_UDF
        got = found(df)
        assert [r[:3] for r in got] == [r[:3] for r in want] and all(g[3:] == pytest.approx(w[3:]) for g, w in zip(got, want))
        for lacking in ("k = 2", "seed = 8"):
            for where in ("sample_id = 0", "sample_id = 8", "category = 'p'", "category = 'q'"):
                with pytest.raises(Exception, match="isn't complete"):
                    stats.comparison_intervals(df.where(f"not ({lacking} and {where})"), {}, {"m": ("a", "b")}, **options).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)


def test_replicates_are_drawn_in_small_pieces():
    sums = [np.random.default_rng(6).random((30_000, 3, 2))]
    tracemalloc.start()
    try:
        stats._replicates(sums, 3, 300, 4880)
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("column", ["category", "k", "seed", "sample_id", "a"])
def test_cells_with_a_null_are_refused(spark, column):
    df = _cells(spark).withColumn(column, F.when((F.col("category") == "c") & (F.col("k") == 1) & (F.col("seed") == 7) & (F.col("sample_id") == "a"), None).otherwise(F.col(column)))
    with pytest.raises(Exception, match="a cell without"):
        stats.clustered_bootstrap(df, ["cmp"], **KEYS, samples=8).collect()


@pytest.mark.parametrize("how,violation", [({"drop": 1}, "incomplete"), ({"twice": True}, "duplicate")])
def test_unbalanced_grids(spark, how, violation):
    df = _cells(spark, **how)
    assert [r.violation for r in stats.unbalanced_cells(df, "category", "k", "seed", "sample_id").collect()] == [violation]
    with pytest.raises(Exception):
        stats.clustered_bootstrap(df, ["cmp"], **KEYS, samples=8).collect()


def test_macro(spark):
    df = spark.createDataFrame([("m", "pcb1", 1, 1, 0.2), ("m", "pcb1", 2, 1, 0.4), ("m", "pcb2", 1, 1, 0.6), ("m", "pcb2", 2, 1, 0.8)], "method string, category string, seed int, k int, v double")
    macro = [r for r in stats.macro_by_seed(df, ["method", "k"], "category", "seed", "v").collect() if r.category == "macro"][0]
    assert macro["mean"] == pytest.approx(0.5) and macro.seed_std == pytest.approx(math.sqrt(0.02)) and macro.n_seeds == 2


def test_single_seed_is_descriptive_and_nulls_are_left_out(spark):
    df = spark.createDataFrame([("m", "c", 1, 0.2, None), ("m", "d", 1, math.nan, 0.4)], "method string, category string, seed int, f1 double, auc double")
    out = stats.all_metrics_macro(df, ["method"], "category", "seed", ["f1", "auc"])
    assert {(r.metric, r.category) for r in out.collect()} == {("f1", "c"), ("auc", "d"), ("f1", "macro"), ("auc", "macro")}
    assert {(r.scope, r.seed_std) for r in out.collect()} == {("descriptive_single_seed", None)}


def test_decision(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.1, 0.2), (-0.2, -0.1, -0.2, -0.1), (-0.1, 0.2, 0.1, 0.2)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(stats.decision(*map(F.col, "abcd"))).collect()] == ["improves", "inferior", "mixed"]


def _records(spark):
    return spark.createDataFrame([(c, f"{c}{i}", "train" if i < 5 else "test", i % 2) for c in ("a", "b") for i in range(7)], "category string, id string, split string, label int")


def test_folds(spark):
    out = sampling.k_folds(_records(spark), ["category"], "id", "split", 5, 1)
    assert out.count() == 14 * 5
    assert out.where("fold_split = 'val'").groupBy("category", "fold").count().where("count <> 1").count() == 0
    assert out.where("fold_split = 'val'").groupBy("id").count().where("count <> 1").count() == 0
    assert out.where("split = 'test' and fold_split <> 'test'").count() == 0


def test_samples_are_nested_and_independent_of_order(spark):
    r = _records(spark)
    few, more = ({x.id for x in sampling.first_k(d, ["category"], "id", k, 3).collect()} for d, k in ((r, 2), (r.orderBy(F.desc("id")).repartition(3), 4)))
    assert few < more and len(few) == 4
    assert sampling.too_small(r, ["category"], 8).count() == 2


def test_validation_split_leaves_one(spark):
    one = spark.createDataFrame([("a", "x", "train"), ("b", "y", "train"), ("b", "z", "train")], "category string, id string, split string")
    got = sampling.train_validation(one, ["category"], "id", "split", 0.9, 1).groupBy("category", "split").count().collect()
    assert {(r.category, r.split, r["count"]) for r in got} == {("a", "train", 1), ("b", "train", 1), ("b", "val", 1)}


def test_tail_and_turns(spark):
    r = _records(spark)
    assert {x.id for x in sampling.tail_validation(r, "id", "split", 3).where("split = 'val'").collect()} == {"b2", "b3", "b4"}
    turns = sampling.interleaved(r, ["category"], "label", "id").where("category = 'a'").orderBy("place").collect()
    assert [t.label for t in turns] == [1, 0, 1, 0, 1, 0, 0]


def test_multilabel_folds_are_even(spark):
    df = spark.createDataFrame([(i, ["x"] if i < 3 else ["x", "y", "y"]) for i in range(6)], "id int, labels array<string>")
    got = sampling.multilabel_folds(df, "id", "labels", 3, 1).groupBy("fold").count().collect()
    assert [r["count"] for r in got] == [2, 2, 2]


def test_tertiles(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(9)] + [(100.0, 0)], "v double, label int")
    got = {r.s: r["count"] for r in sampling.tertiles(df, "v", F.col("label") == 1, "s").groupBy("s").count().collect()}
    assert got == {"small": 3, "medium": 3, "large": 3, "normal": 1}
    flat = df.withColumn("v", F.lit(1.0))
    assert {r.s for r in sampling.tertiles(flat, "v", F.col("label") == 1, "s").collect()} == {"single", "normal"}


def test_tertiles_of_samples(spark):
    """Rows that are many a sample have the thirds of the samples."""
    cells = spark.createDataFrame([(float(i), 1) for i in range(9) for _ in range(1 + 20 * (i == 8))], "v double, label int")
    got = {r.v: r.s for r in sampling.tertiles(cells, "v", F.col("label") == 1, "s", of=cells.distinct()).collect()}
    assert got == {float(i): ("small", "medium", "large")[i // 3] for i in range(9)}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_strata_join_no_table_of_samples(spark):
    """Such a table has a row a sample; where its file is below Spark's threshold, the driver would have to hold and broadcast it."""
    found = contract_queries._strata(spark, str(DATA))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    samples = found.select("category", "sample_id", "area", "thinness").distinct()
    for name in ("area", "thinness"):
        samples = sampling.tertiles(samples, name, F.lit(True), f"{name}_of_sample")
    both = found.join(samples.drop("area", "thinness"), ["category", "sample_id"])
    assert both.count() == found.count() > 0
    assert both.where("area_stratum <> area_of_sample or thinness_stratum <> thinness_of_sample").count() == 0
    assert found.select("area_stratum").distinct().count() == found.select("thinness_stratum").distinct().count() == 3


def test_fill_takes_the_last_and_survives_clashing_names(spark):
    left = spark.createDataFrame([(1, "", "x"), (2, None, "y"), (3, "own", "z")], "k int, p string, __other string")
    right = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (3, 1, "not")], "k int, o int, p string")
    assert {r.k: r.p for r in joins.fill_from(left, right, ["k"], ["o"], ["p"]).collect()} == {1: "new", 2: None, 3: "own"}
    with pytest.raises(ValueError):
        joins.require_unique(right, ["k"])


def test_cache_computes_what_is_missing(spark):
    want, cache = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1, "hit"), (9, "unused")], "k int, v string")
    out = joins.cached_or_computed(want, cache, "k", lambda m: m.withColumn("v", F.lit("made")))
    assert {(r.k, r.v) for r in out.collect()} == {(1, "hit"), (2, "made")}


def test_order_and_cycles(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id string")
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "run_id string, needs string")
    assert {r.run_id: r.level for r in lineage.order_by_dependency(runs, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    with pytest.raises(ValueError, match="cycle"):
        lineage.closure(edges.unionByName(spark.createDataFrame([("a", "c")], "run_id string, needs string")))
    assert lineage.missing_dependencies(runs, spark.createDataFrame([("a", "z")], "run_id string, needs string")).count() == 1


def test_matrices(spark):
    m = lineage.run_matrix(spark, ["x", "sam2_only"], ["p", "q"], [1, 2], [5, 6, 7])
    assert m.count() == 2 * 2 * 3 + 2 and m.select("run_id").distinct().count() == m.count()
    assert lineage.ablation_matrix(spark, {"v": "x"}, ["p", "q"], 4, 1).count() == 2


def test_failure_classes(spark):
    df = spark.createDataFrame([("No such file",), ("run not complete",), ("metric differs",), ("what",)], "m string")
    assert [r[0] for r in df.select(lineage.failure_class(F.col("m"))).collect()] == ["missing", "failed", "semantic", "artifact"]


def test_support_banks_are_all_patches_of_some_samples_of_each_category(spark, monkeypatch):
    """A hot category and a small one: the small one has its own bank, and no patch of a drawn sample is left out."""
    from wafergrid.operators import vectors
    from wafergrid.plans.pipeline_queries import support_banks

    rng = np.random.default_rng(5)
    rows = [(100 * i + j, 0, "hot" if i < 60 else "small", f"s{i:02d}", int(i % 2 == 0), [float(x) for x in rng.normal(size=6)]) for i in range(70) for j in range(9)]
    p = spark.createDataFrame(rows, "patch_id long, backbone int, category string, sample_id string, support int, features array<double>")
    bank, queries = support_banks(p, 3, 4880)
    b, q = bank.collect(), queries.collect()
    for c in ("hot", "small"):
        drawn = {r.sample_id for r in b if r.category == c}
        assert len(drawn) == 3 and sorted(r.patch_id for r in b if r.category == c) == sorted(x[0] for x in rows if x[3] in drawn)
    assert {r.patch_id for r in b} | {r.patch_id for r in q} == {x[0] for x in rows} and len(b) + len(q) == len(rows)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {r.patch_id: min(np.linalg.norm(unit(r.features) - unit(x.features)) for x in b if x.category == r.category) for r in q}
    for most in (vectors.BROADCAST_BYTES, 0):  # broadcast, and in pieces
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", most)
        got = {r.patch_id: r.distance for r in vectors.nearest_distance(queries, bank, "patch_id", "bank_id", "features").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_bootstrap_queries_draw_as_often_as_usual(spark, monkeypatch):
    from wafergrid.plans import result_queries
    from wafergrid.sources.config import ScoringParams

    seen = []
    monkeypatch.setattr(stats, "_checked", lambda confidence, samples: seen.append(samples))
    for name in ("bootstrap_ci", "paired_bootstrap", "clustered_bootstrap"):
        result_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [ScoringParams().bootstrap_samples] * 3
