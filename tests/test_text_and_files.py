from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wafergrid.functions import text
from wafergrid.functions.paths import with_stored_place
from wafergrid.operators.compaction import CompactionPlan, compact, longest_first, published
from wafergrid.sources import config, files
from wafergrid.streaming import scoring


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "path,base,place",
    [
        ("heatmaps/a.npz", "outputs/r", "outputs/r/heatmaps/a.npz"), ("./heatmaps//a.npz ", "outputs/r/", "outputs/r/heatmaps/a.npz"), ("masks\\a.png\t", "outputs/r", "outputs/r/masks/a.png"),
        ("outputs/x/../r/a", "outputs/q", "outputs/r/a"), ("a/b/../../c", "outputs/r", "outputs/r/c"), ("/srv/store/outputs/r/a", None, "outputs/r/a"), ("file:///srv/store/outputs/r/a", None, "outputs/r/a"),
        ("heat%5Fmap+1.npz", "outputs/r", "outputs/r/heat_map+1.npz"), ("bad%zz", "outputs/r", "outputs/r/bad%zz"), ("/elsewhere/a", "outputs/r", None), ("a", None, None), ("", "outputs/r", None), (None, "outputs/r", None), ("\u00a0 \t", "outputs/r", None),
    ],
)
def test_stored_place(spark, path, base, place):
    df = spark.createDataFrame([(path, base)], "p string, b string")
    assert with_stored_place(df, "p", "b", "place", store="/srv/store").first().place == place


def test_annotation_lines(spark):
    b = one(spark, "34,26,51,43,3", text.annotation_box)
    assert (b.x1, b.y1, b.x2, b.y2, b.class_id, b.class_name) == (34, 26, 51, 43, 3, "mousebite")
    assert one(spark, " 1 2  3,4 9 ", text.annotation_box).class_name == "class_9"
    assert [one(spark, v, text.annotation_box) for v in ("1,2,3,4", "a,2,3,4,5", "", None)] == [None] * 4


def test_split_ids(spark):
    assert set(one(spark, "group/00041000_test.jpg", text.split_id_variants)) == {"group/00041000_test.jpg", "00041000_test.jpg", "00041000_test", "00041000"}
    assert "0004_test" in one(spark, "0004", text.split_id_variants)


def test_names(spark):
    assert one(spark, "a b/ü9", text.safe_filename) == "a_b_ü9"
    assert one(spark, "out/pcb3_run/m.json", text.category_of) == "pcb3"
    assert one(spark, "x_ms768_sam2", text.method_of) == "ms768_dinov2_sam2"
    assert one(spark, "512, 768,", text.whole_numbers) == [512, 768]
    assert [one(spark, v, lambda c: text.fixed_point(c.cast("double"), 2)) for v in ("1.5", "Infinity", "NaN", None)] == ["1.50", "inf", "-", "-"]
    assert [one(spark, v, text.exposes_private_path) for v in ("/a", "C:\\x", "a/../b", "a/b", "~x", "ä")] == [True, True, True, False, True, True]
    assert text.public_columns(["a", "b_path", "c_paths_json"]) == ["a"]


def test_label_rules(spark):
    df = spark.createDataFrame([("Good ", "m", "x"), ("??", "m", "x"), (None, "", "a/Bad/x"), (None, None, "a/ok/x")], "w string, m string, p string")
    assert [r[0] for r in df.select(text.label_value(F.col("w"), F.col("m"), F.col("p"))).collect()] == [0, 1, 1, 0]


def test_longest_first_is_balanced():
    groups = longest_first([7, 1, 5, 3, 4, 4], 2)
    loads = [sum(s for s, g in zip([7, 1, 5, 3, 4, 4], groups) if g == i) for i in range(2)]
    assert loads == [12, 12]


def test_compaction_keeps_every_row_once(spark, tmp_path):
    df = spark.createDataFrame([(f"f{i}", (i * 37) % 91 + (10_000 if i == 7 else 0), None if i % 9 == 0 else f"body{i}") for i in range(700)], "path string, size long, body string")
    out = f"file://{tmp_path}/c"
    rows, manifest = compact(df, "path", "size", out=out, plan=CompactionPlan(target_bytes=4_000, shard_files=300))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert manifest["rows"] == 700 and 1 < manifest["files"] < 60
    assert published(spark, out).count() == 700


def test_compaction_of_nothing(spark):
    rows, manifest = compact(spark.createDataFrame([], "path string, size long"), "path", "size")
    assert rows.count() == 0 and manifest["files"] == 0


def test_compaction_refuses_repeated_keys(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "path string, size long")
    with pytest.raises(ValueError, match="not published"):
        compact(df, "path", "size", out=f"file://{tmp_path}/d")
    assert not (tmp_path / "d" / "MANIFEST.json").exists()


def test_csv_checks(spark, tmp_path):
    good, twice, empty = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    good.write_text('sample_id,note\n1,"two\nlines"\n')
    twice.write_text("a,a\n1,2\n")
    empty.write_text("sample_id\n")
    assert files.read_checked_csv(spark, str(good), ["sample_id"]).first().note == "two\nlines"
    for path, need in ((twice, ["a"]), (empty, ["sample_id"]), (good, ["other"])):
        with pytest.raises(ValueError):
            files.read_checked_csv(spark, str(path), need)
    assert files.read_optional_csv(spark, str(tmp_path / "none.csv"), spark.createDataFrame([], "a string").schema).count() == 0


def test_folder_scans(spark, tmp_path):
    for p in ("pcb1/train/good/a.png", "pcb1/test/bad/b.png", "pcb1/masks/b_mask.png", "other/c.png", "pcb1/test/bad/notes.md"):
        (tmp_path / "v" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / p).write_bytes(b"x")
    r = {x.sample_id: x for x in files.dataset_from_config(spark, {"name": "visa_pcb", "root": str(tmp_path / "v")}).collect()}
    assert set(r) == {"pcb1/a", "pcb1/b"} and (r["pcb1/a"].split, r["pcb1/a"].label, r["pcb1/a"].mask_path) == ("train", "0", None) and r["pcb1/b"].mask_path.endswith("b_mask.png")
    for p in ("g/1_test.jpg", "g/1_temp.jpg", "g_not/1.txt", "g/2_test.jpg"):
        (tmp_path / "d" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / p).write_text("1,2,3,4,1\n\n5 6 7 8 2\n")
    b = {x.sample_id: x for x in files.dataset_from_config(spark, {"name": "deeppcb", "root": str(tmp_path / "d")}).collect()}
    assert b["1_test"].template_path.endswith("1_temp.jpg") and b["1_test"].box_path.endswith("g_not/1.txt") and b["2_test"].box_path is None
    boxes = files.read_boxes(spark, str(tmp_path / "d/g_not/1.txt")).orderBy("line_no").collect()
    assert [(x.image_id, x.line_no, x.class_name) for x in boxes] == [("1", 1, "open"), ("1", 3, "short")]
    with pytest.raises(ValueError):
        files.dataset_from_config(spark, {"name": "other"})


def test_boards_of_a_split_list(spark, tmp_path):
    for p in ("g1/1_test.jpg", "g1/1.txt", "g2/2_test.jpg", "g2/3_test.jpg", "g2/4_test.jpg"):
        (tmp_path / "d" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / p).write_text("x")
    (tmp_path / "list.txt").write_text(f"# boards\n\ng1/1.jpg g1_not/1.txt\n3_test.jpg\n{tmp_path}/d/g2/4_test.jpg\n")
    config = {"name": "deeppcb", "root": str(tmp_path / "d"), "split": "val", "split_file": str(tmp_path / "list.txt")}
    got = sorted((r.sample_id, r.category, r.split, r.label) for r in files.dataset_from_config(spark, config).collect())
    assert got == [("1_test", "g1", "val", "1"), ("3_test", "g2", "val", "1"), ("4_test", "g2", "val", "1")]
    every = files.dataset_from_config(spark, {"name": "deeppcb", "root": str(tmp_path / "d")}).collect()
    assert len(every) == 4 and {(r.split, r.label) for r in every} == {("all", "1")}


def test_manifests_by_any_of_their_names(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/b.png").write_bytes(b"x")
    f = tmp_path / "a.csv"

    def read(content, **more):
        f.write_text(content)
        return files.dataset_from_config(spark, {"name": "manifest", "root": str(tmp_path), "manifest_csv": str(f)} | more).collect()

    a, b, c = read("IMG_PATH,is_anomaly,phase,class,ground_truth,name\npcb2/a.png,yes,Training,pcb1,,n1\n/x/b.png,true,holdout,,m/b.png,\npcb3/test/c.png,0,,,m/none.png,\n")
    assert (a.category, a.sample_id, a.split, a.label, a.image_path, a.mask_path) == ("pcb1", "pcb1/n1", "train", "0", f"{tmp_path}/pcb2/a.png", None)
    assert (b.category, b.sample_id, b.split, b.label, b.image_path, b.mask_path) == ("unknown", "unknown/b", "holdout", "1", "/x/b.png", f"{tmp_path}/m/b.png")
    assert (c.category, c.sample_id, c.split, c.label, c.mask_path) == ("pcb3", "pcb3/c", "test", "0", None)
    (d,) = read("filename,annotation,object_type,subset\nd.png,m/none.png,pcb4,val\ne.png,,pcb9,val\n", categories=["pcb4"])
    assert (d.sample_id, d.label, d.mask_path, d.split) == ("pcb4/d", "1", None, "val")
    with pytest.raises(ValueError, match="no column"):
        read("picture,label\na.png,1\n")
    with pytest.raises(Exception, match="row 3: no image path"):
        read("image,label\na.png,1\n ,0\n")


def test_bad_annotation_fails_with_its_line(spark, tmp_path):
    assert files.read_boxes(spark, str(tmp_path / "none.txt")).collect() == []
    (tmp_path / "x.txt").write_text("1,2,3\n")
    with pytest.raises(Exception, match="line 1"):
        files.read_boxes(spark, str(tmp_path / "x.txt")).collect()


def test_arrays_and_views(spark, tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    np.save(tmp_path / "m.npy", a)
    np.savez(tmp_path / "n.npz", heat=a + 1)
    got = {(r.image_id, r.y, r.x): r.score for r in files.read_arrays(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got[("m", 1, 2)] == 5 and got[("n", 0, 0)] == 1
    views = spark.createDataFrame([("i", 0, 0, 0, 4, 4, 2, 2, [1.0, 2.0, 3.0, 4.0], "max"), ("i", 1, 2, 2, 4, 4, 1, 1, [9.0], "max")], files.schemas.COMPONENTS)
    files.write_components(views, str(tmp_path / "views"))
    px = {(r.x, r.y): r.score for r in files.rendered(spark.read.parquet(str(tmp_path / "views"))).collect()}
    assert len(px) == 16 and (px[(0, 0)], px[(3, 0)], px[(3, 3)]) == (1.0, 2.0, 9.0)


def test_metrics_and_json(spark, tmp_path):
    files.write_json(str(tmp_path / "run_pcb2/metrics.json"), {"num_images": 3, "aupro": 0.5})
    r = files.read_metrics(spark, [str(tmp_path / "run_pcb2/metrics.json")]).first()
    assert (r.category, r.num_images, r.aupro, r.image_auroc) == ("pcb2", 3, 0.5, None)
    with pytest.raises(ValueError):
        files.write_json(str(tmp_path / "x.json"), {"a": float("nan")})
    assert json.loads((tmp_path / "run_pcb2/metrics.json").read_text()) == {"aupro": 0.5, "num_images": 3}


def test_configuration(tmp_path):
    (tmp_path / "a.yaml").write_text("a: 1\na: 2\n")
    (tmp_path / "b.yaml").write_text("x: {p: 1, q: 2}\n")
    with pytest.raises(ValueError):
        config.load_yaml(tmp_path / "a.yaml")
    assert config.merged(config.load_yaml(tmp_path / "b.yaml"), {"x": {"q": None, "r": 3}}) == {"x": {"p": 1, "q": 2, "r": 3}}
    assert config.ScoringParams.of({"crop_sizes": [512]}).crop_sizes == (512,)
    for bad in ({"quantile": 1.0}, {"folds": 1}, {"min_area": True}, {"fusion": "sum"}, {"other": 1}, {"crop_overlap": 1.0}):
        with pytest.raises(ValueError):
            config.ScoringParams.of(bad)
    for bad in ({"shots": [1, 1]}, {"methods": ["A"]}, {"seeds": [-1]}):
        with pytest.raises(ValueError):
            config.MatrixConfig(**({"methods": ["a"], "categories": ["b"], "shots": [1], "seeds": [1]} | bad))


def test_stream_scores_and_windows(spark, tmp_path):
    src, bank = tmp_path / "src", spark.createDataFrame([(0, [1.0, 0.0])], "g int, v array<double>")
    spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "id int, g int, v array<double>").write.parquet(str(src))
    stream = spark.readStream.schema("id int, g int, v array<double>").parquet(str(src))
    scoring.to_parquet(scoring.score_stream(stream, bank, "id", "g", "v", 1.0), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.id: r.flagged for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: False, 2: True}
    times = spark.createDataFrame([("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:02:00", 3.0), ("2024-01-01 00:11:00", 5.0)], "t string, s double").select(F.to_timestamp("t").alias("t"), "s")
    got = [(r.n, r["mean"]) for r in scoring.window_summary(times, "t", "s").orderBy("start").collect()]
    assert got == [(2, 2.0), (1, 5.0)]


def test_written_tables_are_dropped(spark):
    from pathlib import Path

    from wafergrid import session

    df = session.written(spark.range(3), "kept")
    path = Path(session._WRITTEN[-1].removeprefix("file://"))
    assert df.count() == 3 and path.exists()
    session.drop_written()
    assert not path.exists()


def test_views_that_are_not_whole_fail(spark, tmp_path):
    good = ("i", 0, 0, 0, 4, 4, 2, 2, [1.0, 2.0, 3.0, 4.0], "max")
    for n, (at, value) in enumerate(((8, [1.0, 2.0]), (9, "median"), (9, None), (4, 0), (8, None))):
        bad = list(good)
        bad[at] = value
        df = spark.createDataFrame([good, tuple(bad)], files.schemas.COMPONENTS)
        with pytest.raises(Exception, match="grid, box or fusion"):
            files.write_components(df, str(tmp_path / f"v{n}"))
    files.write_components(spark.createDataFrame([good], files.schemas.COMPONENTS), str(tmp_path / "v"))
    assert files.read_components(spark, str(tmp_path / "v")).count() == 1
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        files.read_components(spark, str(tmp_path / "other"))


def test_optional_file_on_another_file_system(spark, tmp_path):
    schema = spark.createDataFrame([], "a string, b string").schema
    (tmp_path / "x.csv").write_text('a,b\n1,"2,3"\n')
    assert files.read_optional_csv(spark, f"file:{tmp_path}/x.csv", schema).first().b == "2,3"
    assert files.read_optional_csv(spark, f"file://{tmp_path}/none.csv", schema).count() == 0
    with pytest.raises(Exception):  # a store that can't be reached is no missing file
        files.read_optional_csv(spark, "nowhere://bucket/none.csv", schema)
    (tmp_path / "y.csv").write_text('"a,b",c\n1,2\n')
    assert files.read_checked_csv(spark, str(tmp_path / "y.csv"), ["a,b", "c"]).count() == 1


def test_metrics_that_a_file_lacks(spark, tmp_path):
    for c, content in (("pcb1", {"num_images": 2, "aupro": 0.5, "image_auroc": 0.8}), ("pcb2", {"num_images": 3})):
        files.write_json(str(tmp_path / f"{c}/metrics.json"), content)
    got = {r.category: r for r in files.metric_summary(files.read_metrics(spark, [str(tmp_path / "*/metrics.json")])).collect()}
    assert (got["pcb2"].image_auroc, got["pcb2"].aupro) == (0.0, None)
    assert (got["mean"].num_images, got["mean"].image_auroc, got["mean"].aupro, got["mean"].best_pixel_f1) == (5, 0.4, 0.5, 0.0)


def test_trees_are_listed_by_tasks(spark, tmp_path):
    """The same files that Spark's own scan finds, at any depth; the driver keeps no list of them."""
    for name in ("a/x 1.png", "a/b/ü#%20.PNG", "_h/y.png", ".z/q.png", "a/_w.png", "a/k=_1.png", "c.txt", "_p=1/m.png", "d/e/f/g.jpg", "d/e/n.gif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "none").mkdir()
    found = files.list_files(spark, str(tmp_path), ("png", "txt", "jpg"))
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert sorted(r.path for r in found.collect()) == sorted(r.path for r in scan.collect() if not r.path.endswith(".gif"))
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert files.list_files(spark, str(tmp_path / "none"), ("png",)).collect() == []
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "missing"), ("png",))
