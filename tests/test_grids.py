from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafergrid.operators import grids, models, vectors as vec
from wafergrid.sources.files import synthetic_images


def cells(spark, a, name="i"):
    return spark.createDataFrame([(name, int(x), int(y), float(a[y, x])) for y, x in np.ndindex(*a.shape)], "img string, x int, y int, s double")


def test_components_equal_flood_fill(spark):
    rng = np.random.default_rng(3)
    a = rng.random((12, 17)) < 0.5
    df = cells(spark, a.astype(float)).where("s > 0")
    got = {(r.x, r.y): r.component for r in grids.components(df.unionByName(df), "img").collect()}
    left, want = set(zip(*np.nonzero(a))), {}
    while left:
        start = min(left)
        stack, part = [start], []
        left.discard(start)
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
        name = min(y * (1 << 20) + x for y, x in part)
        want |= {(int(x), int(y)): name for y, x in part}
    assert got == want


def test_regions_point_is_topmost_then_leftmost(spark):
    px = cells(spark, np.array([[1.0, 2, 2], [2, 0, 0]]))
    found = grids.regions(grids.components(px.where("s > 0"), "img"), px, "img", "s").first()
    assert (found.x1, found.y1, found.x2, found.y2, found.area, found.px, found.py) == (0, 0, 3, 2, 4, 1, 0)
    assert grids.top_regions(grids.regions(grids.components(px.where("s > 0"), "img"), px, "img", "s"), "img").count() == 0


def test_crops_reach_the_edge(spark):
    size = spark.createDataFrame([(10, 8)], "w int, h int")
    got = [(r.x1, r.y1, r.x2, r.y2) for r in grids.crop_boxes(size, "w", "h", 4, 0.5).collect()]
    assert (0, 0, 4, 4) in got and (6, 4, 10, 8) in got and len(set(got)) == len(got)
    assert [(r.x2, r.y2) for r in grids.crop_boxes(size, "w", "h", 20, 0.0).collect()] == [(10, 8)]
    with pytest.raises(ValueError):
        grids.crop_boxes(size, "w", "h", 4, 1.0)


@pytest.mark.parametrize("shape", [(3, 5), (7, 2), (1, 1)])
def test_bilinear_equals_numpy(spark, shape):
    a = np.random.default_rng(1).random((4, 3))
    got = np.zeros(shape)
    sizes = spark.createDataFrame([("i", 3, 4)], "img string, width int, height int")
    for r in grids.resize_bilinear(cells(spark, a), sizes, "img", "s", shape[1], shape[0]).collect():
        got[r.y, r.x] = r.s
    ys, xs = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip(shape, a.shape))
    want = np.array([[np.interp(x, range(3), [np.interp(y, range(4), a[:, c]) for c in range(3)]) for x in xs] for y in ys])
    assert np.allclose(got, want)


def test_minmax_without_contrast(spark):
    assert [r.normalized for r in grids.minmax(cells(spark, np.full((1, 3), 2.0)), ["img"], "s").collect()] == [0.0] * 3


def test_perimeter_of_a_square(spark):
    r = grids.perimeter(cells(spark, np.ones((3, 3))), "img").first()
    assert (r.area, r.perimeter) == (9, 12)


def test_boxes_to_cells_round_half_even_and_skip_empty(spark):
    b = spark.createDataFrame([("i", 0.5, 0.5, 1.5, 1.0), ("i", 5.0, 5.0, 4.0, 9.0), ("i", -3.0, 0.0, 0.0, 0.0)], "img string, x1 double, y1 double, x2 double, y2 double")
    assert {(r.x, r.y) for r in grids.boxes_to_cells(b, "img").collect()} == {(x, y) for x in range(3) for y in range(2)}


def test_grid_prompts_stop_at_most(spark):
    s = spark.createDataFrame([("i", 9, 6)], "img string, width int, height int")
    got = grids.grid_prompts(s, "width", "height", 3, 4).orderBy("place").collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in got] == [(0, 0, 3, 2), (3, 0, 6, 2), (6, 0, 9, 2), (0, 2, 3, 4)]
    one = grids.grid_prompts(s, "width", "height", 1, 1, scale=0.5).first()
    assert (one.x1, one.y1, one.x2, one.y2) == (2, 2, 6, 5)  # half to even


def test_best_candidate_falls_back_to_all(spark):
    c = spark.createDataFrame([("i", 0, 0.9, 0.5, 8, 8, 10), ("i", 1, 0.9, 0.5, 9, 9, 10), ("j", 0, 0.1, 0.1, 1, 1, 10), ("j", 1, 0.9, 0.9, 9, 9, 10)], "img string, n int, s double, heat double, inside int, area int, total int")
    best = grids.best_candidate(c, ["img"], "n", model_score="s", heat="heat", inside="inside", area="area", image_area="total", most_area=0.5)
    assert {r.img: r.n for r in best.collect()} == {"i": 0, "j": 0}


def test_nearest_distance_paths_agree_and_meet_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    q, b = rng.normal(size=(40, 6)), rng.normal(size=(30, 6))
    make = lambda m, n: spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(m)] + [(n, 0, None)], "id int, g int, v array<double>")
    dq, db = make(q, 900), make(b, 901)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {i: np.sqrt(((unit(q)[i] - unit(b)[i % 2 :: 2]) ** 2).sum(1)).min() for i in range(40)}
    sql = {r.id: r.distance for r in vec.nearest_distance_sql(vec.memory_bank(dq, "v"), vec.memory_bank(db, "v"), "id", ["g"], "v").collect()}
    fast = {r.id: r.distance for r in vec.nearest_distance(dq, db, "id", "g", "v").collect()}
    monkeypatch.setattr(vec, "BROADCAST_BYTES", 0)
    blocks = {r.id: r.distance for r in vec.nearest_distance(dq, db, "id", "g", "v").collect()}
    for got in (sql, fast, blocks):
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_coreset_is_repeatable_and_of_the_right_size(spark):
    v = spark.createDataFrame([(i, 0, [float(i % 10), float(i // 10)]) for i in range(100)], "id int, g int, v array<float>")
    a, b = (sorted(tuple(r) for r in vec.greedy_coreset(d, "g", "id", "v", ratio=0.1).collect()) for d in (v, v.orderBy(F.desc("id"))))
    assert a == b and len(a) == 10
    with pytest.raises(ValueError):
        vec.greedy_coreset(v, "g", "id", "v", ratio=0)


def test_color_patches_of_made_images(spark):
    p = models.color_patches(synthetic_images(spark), "sample_id", 16)
    assert p.count() == 5 * 16 and p.select(F.size("vec")).distinct().collect()[0][0] == 3
