from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafergrid.llm import ledger, neighbors, overlaps, percentiles


def _points(spark, rows):
    return spark.createDataFrame(rows, "g string, part string, v double")


def test_percentiles_equal_sorting_for_any_cut_of_the_rows(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=900).tolist(), "hot": rng.integers(0, 40, 4000).astype(float).tolist(), "one": [7.0], None: rng.random(50).tolist(), "tail": (rng.pareto(1, 700) * 1e6).tolist()}
    rows = [(g, str(i % 5), v) for g, vs in data.items() for i, v in enumerate(vs)] + [("a", "0", None), ("a", "1", math.nan), ("a", "1", math.inf)]
    ps = (0.01, 0.5, 0.9, 1.0)
    want = {(g, p): sorted(vs)[max(1, math.ceil(p * len(vs))) - 1] for g, vs in data.items() for p in ps}
    days = percentiles.summarize(_points(spark, rows), ["g"], "part", "v", bits=None)
    for cell_rows, halvings in ((8, 1), (64, 3), (10_000, 5)):
        got = percentiles.multi_select(percentiles.merge([days], ["g"]), ["g"], ps, cell_rows=cell_rows, halvings=halvings)
        assert {(r.g, r.p): r.value for r in got.collect()} == want
    early, late = days.where("part < '2'"), days.where("part >= '2'")
    got = percentiles.multi_select(percentiles.merge([early, late], ["g"]), ["g"], ps)
    assert {(r.g, r.p): r.value for r in got.collect()} == want


def test_summaries_of_days_are_saved_and_added_to(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("g" if i % 3 else "h", str(i % 7), float(v)) for i, v in enumerate(rng.normal(size=700))]
    store, df = f"file://{tmp_path}/store", _points(spark, rows)
    assert percentiles.saved_summaries(spark, store) is None
    later = spark.newSession()
    for name, some in (("monday", "part < '4'"), ("tuesday", "part >= '4'"), ("monday", "part < '4'")):  # a delivery that comes again counts once
        percentiles.save_summary(percentiles.summarize(df.where(some), ["g"], "part", "v", bits=None), store, name)
    got = percentiles.multi_select(percentiles.merge([percentiles.saved_summaries(later, store)], ["g"]), ["g"], [0.5])
    want = {g: sorted(v for a, _, v in rows if a == g) for g in "gh"}
    assert {r.g: (r.n_values, r.value) for r in got.collect()} == {g: (len(v), v[math.ceil(len(v) / 2) - 1]) for g, v in want.items()}


def test_a_hot_group_is_spread_over_cells(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.lit("0").alias("part"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    points = percentiles.merge([percentiles.summarize(df, ["g"], "part", "v", bits=None)], ["g"])
    got = percentiles.multi_select(points, ["g"], [0.5, 0.999], cell_rows=4_096).collect()
    want = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert {r.p: r.value for r in got} == {0.5: want[99_999], 0.999: want[199_799]}


def test_rounding_keeps_its_bound(spark):
    v = [0.0, 1.0, -3.7, 0.25, 1e-300, 123456789.123, 0.2499999]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for r in df.select("v", percentiles.rounded(F.col("v"), 10).alias("r")).collect():
        assert abs(r.r - r.v) <= abs(r.v) * 2**-10


def test_percentiles_of_nothing(spark):
    none = percentiles.summarize(_points(spark, []), ["g"], "part", "v", bits=10)
    assert percentiles.multi_select(percentiles.merge([none], ["g"]), ["g"], [0.5]).collect() == []
    with pytest.raises(ValueError):
        percentiles.multi_select(none.drop("part"), ["g"], [0.0])


def _batch(spark, keys, step):
    df = spark.createDataFrame([("g", k) for k in keys] + [("g", None), ("other", "z")], "g string, k string").withColumn("step", F.lit(step))
    return df.withColumn("priority", ledger.priority(F.lit(5), F.coalesce("k", F.lit(""))))


def _quota(spark, n):
    return spark.createDataFrame([("g", n), ("g", None)], "g string, quota int")


def test_ledger_keeps_what_it_holds_and_grows(spark):
    first = ledger.extend_ledger(None, _batch(spark, map(str, range(50)), 1), _quota(spark, 4), ["g"], "k")
    again = ledger.extend_ledger(None, _batch(spark, [str(i) for i in reversed(range(50))] * 2, 1).repartition(7), _quota(spark, 4), ["g"], "k")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) and first.count() == 4
    same = ledger.extend_ledger(first, _batch(spark, map(str, range(200)), 2), _quota(spark, 4), ["g"], "k")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, first.collect()))
    more = ledger.extend_ledger(first, _batch(spark, map(str, range(200)), 3), _quota(spark, 9), ["g"], "k")
    assert more.count() == 9 and more.join(first, ["g", "k"]).count() == 4
    assert sorted(r.place for r in more.collect()) == list(range(1, 10))
    less = ledger.extend_ledger(more, _batch(spark, ["new"], 4), _quota(spark, 2), ["g"], "k")
    assert less.count() == 9


def test_deliveries_at_once_or_one_by_one(spark):
    a, b = _batch(spark, map(str, range(6)), 1), _batch(spark, map(str, range(3, 40)), 2)
    one = ledger.extend_ledger(ledger.extend_ledger(None, a, _quota(spark, 9), ["g"], "k"), b, _quota(spark, 9), ["g"], "k")
    both = ledger.extend_ledger(None, b.unionByName(a), _quota(spark, 9), ["g"], "k")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, both.collect()))


def test_a_late_record_of_an_early_delivery_displaces_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    assert ledger.saved_ledger(spark, path) is None
    early = ledger.extend_saved_ledger(path, _batch(spark, map(str, range(20)), 2), _quota(spark, 5), ["g"], "k").collect()
    late = _batch(spark, [f"late{i}" for i in range(50)], 1)
    assert sorted(ledger.extend_saved_ledger(path, late, _quota(spark, 5), ["g"], "k").collect()) == sorted(early)
    other = spark.newSession()
    grown = ledger.extend_saved_ledger(path, late.unionByName(_batch(spark, ["x"], 3)), _quota(spark, 8), ["g"], "k")
    kept = sorted(map(tuple, ledger.saved_ledger(other, path).collect()))
    assert kept == sorted(map(tuple, grown.collect())) and set(map(tuple, early)) <= set(kept)
    assert [r[1][:4] for r in sorted(kept, key=lambda r: r[3])[5:]] == ["late"] * 3


def _vectors(spark, spaces):
    rows = [(s, i, [float(x) for x in v]) for s, items in spaces.items() for i, v in items]
    return spark.createDataFrame(rows, "space string, id long, vec array<float>")


def _brute(spaces, asked, k):
    out = {}
    for items in spaces.values():
        items = dict(items)
        ids = np.array(sorted(items))
        m = np.array([items[i] for i in ids], dtype=np.float32).astype(float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for q in asked & set(items):
            s = np.round(m @ m[np.searchsorted(ids, q)], 12)
            order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
            out[q] = [int(ids[i]) for i in order]
    return out


def test_neighbours_of_uneven_clusters_and_copies(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    dense = [(i, centres[i % 3] + 0.05 * rng.normal(size=16)) for i in range(900)] + [(900 + i, centres[3 + i % 9] + 0.6 * rng.normal(size=16)) for i in range(600)]
    copies = [(2000 + i, dense[1][1] * 1.0) for i in range(400)]
    small = [(5000 + i, rng.normal(size=8) * 1e-20) for i in range(3)]
    spaces = {"big": dense + copies, "small": small}
    v = _vectors(spark, spaces)
    asked = {0, 1, 5, 901, 1400, 2003, 5001}
    got: dict[int, list] = {}
    params = neighbors.ListParams(list_rows=60, least_sample=600)
    for r in neighbors.nearest(v.unionByName(v.where("id < 50")), v.where(F.col("id").isin(*asked)), 5, params).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.neighbor)
    want = _brute(spaces, asked, 5)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.9 and got[2003] == want[2003] and got[5001] == want[5001]


def _share_found(spark, v, spaces, asked, params):
    got: dict[int, set] = {}
    for r in neighbors.nearest(v, v.where(F.col("id").isin(*asked)), 5, params).collect():
        got.setdefault(r["query"], set()).add(r.neighbor)
    want = _brute(spaces, asked, 5)
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in got)
    return sum(len(got[q] & set(want[q])) for q in want) / (5 * len(want))


def test_neighbours_where_few_lists_are_read(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(40, 16))
    spaces = {"s": [(i, centres[min(39, int(rng.exponential(8)))] + rng.uniform(0.1, 0.6) * rng.normal(size=16)) for i in range(6000)]}
    v = _vectors(spark, spaces).cache()
    asked = set(range(0, 6000, 60))
    whole = neighbors.ListParams(list_rows=12, least_sample=2_000)
    fitted = neighbors.fit_spaces(v, whole)
    lists = len(fitted["s"].centroids)
    read = neighbors.probes(v.where(F.col("id").isin(*asked)), fitted, whole).count() / len(asked) / lists
    assert lists > 300 and read < 0.2 and _share_found(spark, v, spaces, asked, whole) >= 0.95
    divided = neighbors.ListParams(list_rows=60, top_lists=8, least_sample=600)
    assert (neighbors.fit_spaces(v, divided)["s"].leaves > 1).any() and _share_found(spark, v, spaces, asked, divided) >= 0.95


def test_neighbours_in_parts_of_long_lists(spark, monkeypatch):
    rng = np.random.default_rng(15)
    spaces = {"s": [(i, rng.normal(size=8)) for i in range(1500)]}
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 300)
    params = neighbors.ListParams(list_rows=500, least_sample=1_500)
    v = _vectors(spark, spaces)
    assert (neighbors.fit_spaces(v, params)["s"].parts > 1).all() and _share_found(spark, v, spaces, {1, 2, 3, 700}, params) == 1


def test_neighbours_of_nothing(spark):
    v = _vectors(spark, {})
    assert neighbors.nearest(v, v, 5).collect() == []


def test_unusable_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    assert [r.id for r in df.where(neighbors.usable(F.col("v"), F.lit(2))).collect()] == [0]


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(6)
    c = rng.normal(size=(400, 12)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    g, hits = neighbors.CentroidGraph(c), 0
    for q in c[:50] + 0.05 * rng.normal(size=(50, 12)).astype(np.float32):
        q = q / np.linalg.norm(q)
        ids, d = g.search(q[None], 16)
        assert (np.diff(d[0]) >= 0).all()
        hits += len(set(ids[0, :8]) & set(np.argsort(-(c @ q))[:8]))
    assert hits / 400 > 0.95


@pytest.mark.parametrize("n", [1, 2, 500])
def test_centroids_are_balanced(n):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 6)) * np.where(rng.random((n, 1)) < 0.8, 0.01, 1) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, share = neighbors.balanced_centroids(x, 10, 4, 1)
    assert len(c) == len(share) and share.sum() == pytest.approx(1) and (n < 500 or share.max() <= 2 / 10 + 1e-9)


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("pcb1/00012", "PCB1\\00012", True), ("pcb1/00012", " pcb1_00012 ", True), ("pcb1/00012", "Pcb1//00012.png.JPG", True), ("pcb1/00012", "pcb１/０００１２ (2)", True), ("pcb1/00012", "pcb1/00012 - copy", True),
        ("dp00012", "dp-00012_dup", True), ("pcb1/00012", "pcb1/00013", False), ("pcb1/00012", "pcb2/00012", False), ("pcb1/1", "pcb11", True),
    ],
)
def test_sample_keys(spark, a, b, same):
    k = [r.key for r in overlaps.with_sample_key(spark.createDataFrame([(a,), (b,)], "s string"), "s", "key").collect()]
    assert (k[0] == k[1]) == same


def test_hash_keys(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(h,), (" SHA256:" + h.upper() + "\t",), ("xyz",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(overlaps.sha_key(F.col("s"))).collect()] == [h, h, None, None, None]


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=64) * 20
    thumbs = [np.clip(128 + base + 25 * rng.normal(size=64), 0, 255).astype(int) for _ in range(120)]
    splits = ["Train ", "training", "val", "TEST", None, "other"]
    records, images = [], []
    for i in range(240):
        t = thumbs[i % 120]
        if i >= 120:
            t = np.clip(t + rng.normal(size=64) * rng.choice([0, 2, 8, 30]), 0, 255).astype(int)
        records.append((i, "d", f"s/{i}", splits[i % 6] if i < 120 else splits[(i + i // 7) % 6]))
        images.append((f"s/{i}", f"{i % 200:064x}" if i % 3 else None, [int(x) for x in t] if i % 11 else None))
    records += [(900, "d", "S_7.png", "val"), (901, "d", None, "val"), (902, "d", "s/1", "train"), records[0]]
    images += [("s/3", None, [5] * 64), ("s/4", "bad", [1, 2]), ("s/5", None, [None] * 64), (None, "ff" * 32, None)]
    r = spark.createDataFrame(records, "record_id long, dataset string, sample_id string, split string").withColumn("key", F.lit(1))
    m = spark.createDataFrame(images, "sample_id string, image_sha256 string, thumb array<smallint>")
    found = overlaps.cross_split_pairs(r, m).collect()
    got = {(x.train_id, x.eval_id) for x in found}
    assert len(found) == len(got)

    side = {i: {"train": "t", "training": "t", "val": "e", "test": "e"}.get((s or "").strip().lower()) for i, _, _, s in records}
    core = lambda s: s and s.lower().removesuffix(".png").replace("/", "").replace("_", "")
    by: dict[str, list] = {}
    for s, h, t in images:
        by.setdefault(s, []).append((h, t))
    good = lambda t: t is not None and len(t) == 64 and None not in t and len(set(t)) > 1

    def linked(a, b):
        if core(a[2]) is not None and core(a[2]) == core(b[2]):
            return True
        for h1, t1 in by.get(a[2], []) if a[2] else []:
            for h2, t2 in by.get(b[2], []) if b[2] else []:
                if h1 and h1 == h2 or good(t1) and good(t2) and np.corrcoef(t1, t2)[0, 1] >= 0.95:
                    return True
        return False

    want = {(a[0], b[0]) for a in records for b in records if side[a[0]] == "t" and side[b[0]] == "e" and linked(a, b)}
    assert got == want and want


def test_overlaps_near_by_their_layout(spark):
    """A hot board of low contrast: 3 to 8 % of a thumb's energy is its own, so pairs are near by the layout alone."""
    rng = np.random.default_rng(12)
    layouts = rng.normal(size=(4, 64))
    thumbs = []
    for i in range(400):
        board = 0 if i % 3 == 0 else 1 + i % 3
        base, noise = (x - x.mean() for x in (layouts[board], rng.normal(size=64)))
        own = rng.uniform(0.03, 0.08) if board == 0 else rng.uniform(0.2, 0.8)
        z = base / np.linalg.norm(base) * np.sqrt(1 - own) + noise / np.linalg.norm(noise) * np.sqrt(own)
        thumbs.append([int(v) for v in np.clip(np.round(128 + 280 * z), 0, 255)])
    r = spark.createDataFrame([(i, "d", f"s{i}", ("train", "val")[i % 2]) for i in range(400)], "record_id long, dataset string, sample_id string, split string")
    m = spark.createDataFrame([(f"s{i}", None, t) for i, t in enumerate(thumbs)], "sample_id string, image_sha256 string, thumb array<smallint>")
    c = np.corrcoef(np.array(thumbs))
    want = {(a, b) for a in range(0, 400, 2) for b in range(1, 400, 2) if c[a, b] >= 0.95}
    for params in (overlaps.BandParams(), overlaps.BandParams(slice_thumbs=40), overlaps.BandParams(slice_thumbs=6, together=256)):  # in slices, and in blocks of them
        assert {(x.train_id, x.eval_id) for x in overlaps.cross_split_pairs(r, m, params).collect()} == want
    assert len(want) > 1000


def test_buckets_take_no_disk(spark):
    """What is written follows the thumbs, however many blocks there are: 64 bytes and a number for each side, no buckets."""
    from pathlib import Path

    from wafergrid.session import shared_dir

    n, rng = 4_000, np.random.default_rng(8)
    rows = [(i, rng.integers(0, 256, 64).astype("u1").tobytes(), i % 2 == 0, i % 2 == 1) for i in range(n)]
    rows[1] = (1, bytes([*rows[0][1][:-1], rows[0][1][-1] ^ 1]), False, True)
    classes = spark.createDataFrame(rows, "class_id long, thumb binary, train boolean, eval boolean")
    used = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    before = used()
    found = overlaps.near_thumbs(classes, overlaps.BandParams(slice_thumbs=1_000))
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
    assert used() - before < 200 * n
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_overlaps_of_nothing(spark):
    r = spark.createDataFrame([], "record_id long, dataset string, sample_id string, split string")
    m = spark.createDataFrame([], "sample_id string, image_sha256 string, thumb array<smallint>")
    assert overlaps.cross_split_pairs(r, m).collect() == []


def test_packed_thumbs():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (50, 64))
    y = np.where(rng.random((50, 1)) < 0.5, x + rng.integers(-3, 3, (50, 64)), rng.integers(0, 256, (50, 64))).clip(0, 255)
    y[7] = y[7] * 100
    packed = [next(overlaps._packed([pa.RecordBatch.from_pydict({"t": pa.array([list(map(int, r)) for r in m], pa.list_(pa.int16()))})])).column(0) for m in (x, y)]
    assert [len(b) for b in packed[1].to_pylist()].count(128) == 1
    want = np.array([np.corrcoef(a, b)[0, 1] for a, b in zip(x, y)])
    assert np.allclose((overlaps._standard(packed[0].to_pylist()) * overlaps._standard(packed[1].to_pylist())).sum(1), want)


def test_jaccard_equals_that_of_shingle_sets_and_has_its_bound():
    rng = np.random.default_rng(5)
    p = overlaps.BandParams()
    z, e = (m - m.mean(1, keepdims=True) for m in rng.normal(size=(2, 200, 64)))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    e -= (e * z).sum(1, keepdims=True) * z
    near = 0.95 * z + np.sqrt(1 - 0.95**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    a, b = overlaps.quantised(z, p), overlaps.quantised(near, p)
    sets = [[{(i, o, (int(v) + o) // p.offsets) for i, v in enumerate(row) for o in range(p.offsets)} for row in m] for m in (a, b)]
    want = [len(s & t) / len(s | t) for s, t in zip(*sets)]
    assert np.allclose(overlaps.jaccard(a, b, p), want) and min(want) > 0.65 > p.jaccard


def test_one_hash_of_many_records_makes_no_pairs(spark):
    """A hundred thousand records of one image hash: one class a set of images, and links counted by class."""
    n = 100_000
    ids = spark.range(n).select("id", F.concat(F.lit("s"), F.col("id")).alias("sample_id"))
    r = ids.select(F.col("id").alias("record_id"), F.lit("d").alias("dataset"), "sample_id", F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"))
    thumb = F.when(F.col("id") % 1000 == 1, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * i % 251).cast("smallint")))
    m = ids.select("sample_id", F.lit("ab" * 32).alias("image_sha256"), thumb.alias("thumb"))
    found = overlaps.overlaps(r, m)
    assert found.links.count() == 2 and found.records.select("image_class").distinct().count() == 2
    counts = overlaps.link_counts(found, True).collect()
    assert {c.n_links for c in counts} == {3 * n // 4} and len(counts) == n // 4  # each has a sample id of its own
    assert overlaps.link_counts(found, False).agg(F.sum("n_links")).first()[0] == n // 4 * (3 * n // 4)
