"""What operators demand of their input: each broken rule is an error that names what broke it."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafergrid.functions import text
from wafergrid.operators import joins, lineage, masks, sampling, stats, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


GRID = [("m", 1, c, s, v) for c, s, v in (("pcb1", 1, 0.2), ("pcb1", 2, 0.4), ("pcb2", 1, 0.6), ("pcb2", 2, 0.8))]
GRID_SCHEMA = "method string, k int, category string, seed int, v double"


def test_macro_with_intervals(spark):
    got = {r.category: r for r in stats.macro_with_intervals(frame(spark, GRID, GRID_SCHEMA), ["method", "k"], "category", "seed", "v").collect()}
    m = got["macro"]
    assert (m["mean"], m.n_categories, m.n_seeds, m.aggregation) == (pytest.approx(0.5), 2, 2, "category_macro") and m.seed_std == pytest.approx(math.sqrt(0.02))
    want = stats.bootstrap_mean(np.array([0.4, 0.6]))
    assert (m.ci_low, m.ci_high) == (pytest.approx(want[1]), pytest.approx(want[2]))
    assert (got["pcb1"]["mean"], got["pcb1"].n_categories) == (pytest.approx(0.3), 1)


@pytest.mark.parametrize("rows,match", [(GRID[:-1], "same seeds"), ([*GRID, GRID[0]], "more than once")])
def test_ragged_and_repeated_grids(spark, rows, match):
    with pytest.raises(ValueError, match=match):
        stats.macro_with_intervals(frame(spark, rows, GRID_SCHEMA), ["method", "k"], "category", "seed", "v")


def test_comparisons_by_level(spark):
    rows = [("pcb1", k, s, i, 0.1 * i, 0.1 * i + d, "a" if i < 2 else "b") for k in (1, 2) for s in (1, 2) for i, d in enumerate((0.2, -0.1, 0.3))]
    df = frame(spark, rows, "category string, k int, seed int, sample_id int, x double, y double, stratum string")
    got = {(r.metric, r.scope, r.level): r for r in stats.comparison_intervals(df, {"k": F.col("k"), "stratum": F.col("stratum")}, {"f1": ("x", "y")}, category="category", shot="k", seed="seed", sample="sample_id").collect()}
    assert set(got) == {("f1", "overall", "all"), ("f1", "k", "1"), ("f1", "k", "2"), ("f1", "stratum", "a"), ("f1", "stratum", "b")}
    assert got["f1", "stratum", "a"].mean_delta == pytest.approx(0.05) and got["f1", "stratum", "b"].n_images == 1 and got["f1", "overall", "all"].n_rows == 12
    assert got["f1", "overall", "all"].ci_low <= got["f1", "overall", "all"].mean_delta <= got["f1", "overall", "all"].ci_high


def test_strict_pairs(spark):
    a, b = frame(spark, [("s1", 0.1), ("s2", 0.2)], "id string, v double"), frame(spark, [("s1", 0.3), ("s2", 0.1)], "id string, v double")
    assert {r.id: (r.baseline, r.candidate) for r in joins.paired_strictly(a, b, ["id"], "v").collect()} == {"s1": (0.1, 0.3), "s2": (0.2, 0.1)}
    for bad, match in ((b.where("id = 's1'"), "no row of candidate"), (b.unionByName(b.where("id = 's1'")), "repeated or missing"), (b.withColumn("id", F.when(F.col("id") == "s1", "s1")), "repeated or missing")):
        with pytest.raises(Exception, match=match):
            joins.paired_strictly(a, bad, ["id"], "v").collect()
        with pytest.raises(Exception, match=match.replace("candidate", "baseline")):
            joins.paired_strictly(bad, a, ["id"], "v").collect()
    assert joins.paired_strictly(a.limit(0), b.limit(0), ["id"], "v").collect() == []


def test_three_sides(spark):
    side = lambda ids: frame(spark, [(i, i * 10) for i in ids], "id int, v int")
    sides = {"heat": side([1, 2]), "guided": side([1, 2]), "fused": side([1, 2, 3])}
    got = joins.matched(sides, ["id"], optional=["fused"]).select("id", "heat.v", F.col("fused.v").alias("w")).collect()
    assert sorted(map(tuple, got)) == [(1, 10, 10), (2, 20, 20)]
    with pytest.raises(Exception, match="no row of heat, guided"):
        joins.matched(sides, ["id"]).select("id", "heat.v").collect()
    assert [tuple(r) for r in joins.missing_partners(sides, ["id"]).collect()] == [(3, "heat,guided")]


def test_mask_rows(spark):
    rows = [("a", "p1", "t1", 1), ("b", None, "t1", 1), ("c", " ", None, 0), ("d", "p1", None, 0), ("e", "none", None, 0)]
    cells = frame(spark, [("p1", 0, 0), ("p1", 0, 1), ("t1", 0, 1), ("t1", 1, 1)], "path string, x int, y int")
    df = frame(spark, rows, "id string, pred string, goal string, label int")
    got = {r.id: (r.tp, r.fp, r.fn, r.iou) for r in masks.evaluated(df, ["id"], "pred", "goal", "label", cells, "path").collect()}
    assert got == {"a": (1, 1, 1, pytest.approx(1 / 3)), "d": (0, 2, 0, 0.0), "e": (0, 0, 0, 1.0)}
    with pytest.raises(Exception, match="anomalous row without a target"):
        masks.evaluated(df.withColumn("label", F.lit(1)), ["id"], "pred", "goal", "label", cells, "path").collect()


def test_spans_equal_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *(",".join(map(str, rng.integers(0, 6, rng.integers(0, 9)))) for _ in range(2))) for i in range(60)]
    df = frame(spark, rows, "id int, a string, b string")
    spans = [masks.run_spans(df, ["id"], c) for c in "ab"]
    got = {r.id: (r.first_cells, r.second_cells, r.both, r.differing) for r in masks.span_counts(*spans, ["id"]).collect()}

    def cells(runs):
        out, at = set(), 0
        for i, n in enumerate(int(x) for x in runs.split(",") if x):
            out |= set(range(at, at + n)) if i % 2 else set()
            at += n
        return out

    want = {i: (len(x), len(y), len(x & y), len(x ^ y)) for i, x, y in ((i, cells(a), cells(b)) for i, a, b in rows) if x or y}
    assert got == want
    assert masks.run_spans(frame(spark, [(1, None), (2, ""), (3, "5")], "id int, a string"), ["id"], "a").collect() == []


def test_matrix_filters(spark):
    runs = lineage.run_matrix(spark, ["a", "sam2_only"], ["pcb1"], [1], [5])
    assert [r.run_id for r in lineage.filtered_runs(runs, method="a", category="pcb1").collect()] == ["a__pcb1__fold0__k1__seed5"]
    with pytest.raises(ValueError):
        lineage.filtered_runs(runs, run_id="nothing")


def test_few_shots_need_enough(spark):
    df = frame(spark, [("a", i) for i in range(5)] + [("b", 1)], "g string, id int")
    assert sampling.few_shots(df.where("g = 'a'"), ["g"], "id", 3, 1).count() == 3
    with pytest.raises(Exception, match="fewer than 3"):
        sampling.few_shots(df, ["g"], "id", 3, 1).collect()


def test_flags_and_fractions(spark):
    df = frame(spark, [("Yes", "25%"), (" off", "1/4"), (None, " "), ("", "1")], "a string, b string")
    assert [tuple(r) for r in df.select(text.flag(F.col("a")), text.fraction(F.col("b"))).collect()] == [(True, 0.25), (False, 0.25), (None, None), (None, 1.0)]
    for a, b in (("perhaps", "1"), ("1", "1.5"), ("1", "1/0"), ("1", "x")):
        with pytest.raises(Exception, match="no (flag|fraction)"):
            frame(spark, [(a, b)], "a string, b string").select(text.flag(F.col("a")), text.fraction(F.col("b"))).collect()


def test_identities_and_evidence(spark):
    a, b = frame(spark, [("r1", "x"), ("r2", None), ("r3", "z")], "id string, h string"), frame(spark, [("r1", "y"), ("r2", None), ("r4", "z")], "id string, h string")
    assert sorted(map(tuple, lineage.changed_identities(a, b, "id", "h").collect())) == [("r1", "changed"), ("r3", "removed"), ("r4", "added")]
    same = lambda df: lineage.evidence_manifest({"t": (df, ["id", "h"])}).first()
    assert same(a) == same(a.orderBy(F.desc("id")).repartition(3)) and same(a).checksum != same(b).checksum and same(a.limit(0)).checksum == "0"
    assert same(frame(spark, [("a", None)], "id string, h string")).checksum != same(frame(spark, [("a", "")], "id string, h string")).checksum


def test_recalibration(spark):
    scores = frame(spark, [("r", float(i)) for i in range(11)] + [("r", math.nan)], "run string, s double")
    t = frame(spark, [("r", 5.0), ("r2", 1.0)], "run string, t double")
    got = {r.run: (r.n_scores, r.again, r.close) for r in lineage.recalibrated(t, scores, ["run"], "t", "s", 0.5).collect()}
    assert got == {"r": (11, 5.0, True), "r2": (0, None, None)}


def test_cores_of_a_bank_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CORE_ROWS", 100)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 4)) * 0.05, rng.normal(size=(40, 4)) + 8 * np.eye(4)[rng.integers(0, 4, 40)]])
    df = frame(spark, [("hot", f"{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("small", "s", [1.0] * 4), ("copies", "c1", [2.0] * 4), ("copies", "c2", [2.0] * 4), ("none", "n", None)], "g string, id string, v array<double>")
    got = vectors.greedy_coreset(df, "g", "id", "v", ratio=0.1).collect()
    hot = [r for r in got if r.g == "hot"]
    assert sorted(r.place for r in hot) == list(range(1, 95)) and {r.g for r in got} == {"hot", "small", "copies"}
    chosen = x[[int(r.id) for r in hot]]
    far = np.sqrt(((x[:, None] - chosen[None]) ** 2).sum(2)).min(1)
    assert far.max() < 1.5 and (np.array([int(r.id) for r in hot]) >= 900).sum() >= 30  # the sparse vectors are all near one that was chosen
    again = vectors.greedy_coreset(df.repartition(5), "g", "id", "v", ratio=0.1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_draws_in_pieces_are_the_same(monkeypatch):
    values = np.random.default_rng(2).normal(size=301)
    want = stats.bootstrap_mean(values, samples=600)
    whole = np.random.default_rng(4).integers(0, 301, size=(256, 301))
    for piece in (1, 301 * 7, 301 * 100):
        monkeypatch.setattr(stats, "PIECE", piece)
        assert stats.bootstrap_mean(values, samples=600) == want
        assert (np.concatenate(list(stats._draws(np.random.default_rng(4), 301, 256))) == whole).all()


def test_reconciled_measures(spark):
    rows = [(1, 0.5, 0.5), (2, 0.5, 0.5 + 1e-13), (3, 0.5, 0.6), (4, None, 0.5), (5, None, None), (6, math.inf, math.inf), (7, math.inf, 1.0), (8, math.nan, 1.0), (9, 1e12, 1e12 + 1)]
    df = frame(spark, rows, "id int, a double, b double")
    assert sorted(r.id for r in lineage.reconciled(df, ["id"], {"m": (F.col("a"), F.col("b"))}).collect()) == [3, 4, 7, 8]


def test_unmet_dependencies(spark):
    edges = frame(spark, [("c", "b"), ("b", "a"), ("c", "x"), ("b", "n"), ("b", "m")], "run_id string, needs string")
    runs = frame(spark, [("a", "1"), ("a", "1"), ("b", "2"), ("c", "3"), ("n", None), ("m", "4"), ("m", "5")], "run_id string, h string")
    got = {(r.run_id, r.needs): (r.depth, r.problem) for r in lineage.unmet_dependencies(runs, edges, "h").collect()}
    assert got == {("c", "x"): (1, "missing"), ("b", "n"): (1, "unnamed"), ("c", "n"): (2, "unnamed"), ("b", "m"): (1, "ambiguous"), ("c", "m"): (2, "ambiguous")}


def test_referenced_artifacts(spark):
    asked = frame(spark, [("p",), ("p",), ("q",), ("gone",), (None,)], "place string")
    files = frame(spark, [("p", 1, "x"), ("p", 2, "x"), ("q", 3, "x"), ("q", 4, "y"), ("other", 5, "z")], "place string, file_id long, payload string")
    got = {r.place: (r.n_references, r.n_files, r.problem, r.sha256 is None) for r in lineage.referenced_artifacts(asked, files, "payload").collect()}
    assert got == {"p": (2, 2, None, False), "q": (1, 2, "several", True), "gone": (1, 0, "missing", True), None: (1, 0, "outside", True)}
