"""Queries on files: each writes what the tables hold in the formats that runs exchange, and reads it again by the scans."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafergrid.functions import text
from wafergrid.plans._views import IMAGES, PIXELS, RECORDS, RESULTS, images, pixels, records, run_results
from wafergrid.session import scratch_path, written
from wafergrid.sources import files, schemas
from wafergrid.sources.tables import table


def placed(df: DataFrame) -> int:
    """Write each row of (path, content BINARY) as a file, wherever the path's scheme leads; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        for batch in batches:
            made: set[str] = set()
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = pafs.FileSystem.from_uri(path)
                if (folder := at.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(at) as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return written(df.select("path", "content").mapInArrow(run, "n long"), "files").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _made(spark: SparkSession, name: str) -> str:
    """A folder that is there, also where no file is written into it."""
    from wafergrid.session import _file_system

    fs, at = _file_system(spark, path := scratch_path(spark, name))
    fs.mkdirs(at)
    return path


SCORE_COLUMNS = ("score_id", "run_id", "dataset", "sample_id", "category", "label", "image_score", "image_path")


def _score_file(spark: SparkSession, root: str) -> tuple[str, T.StructType]:
    s = table(spark, root, "scores").select(*SCORE_COLUMNS).distinct()
    files.write_csv(s, path := scratch_path(spark, "scores_csv"))
    return path, s.schema


def csv_scan(spark: SparkSession, root: str) -> DataFrame:
    path, schema = _score_file(spark, root)
    out = files.read_csv(spark, path, schema)
    return out.select(*[F.round(text.null_for_nan(F.col(c)), 9).alias(c) if c == "image_score" else c for c in SCORE_COLUMNS])


def optional_scan(spark: SparkSession, root: str) -> DataFrame:
    """Of two files one of which isn't there."""
    path, schema = _score_file(spark, root)
    both = files.read_optional_csv(spark, path, schema).unionByName(files.read_optional_csv(spark, path + "-none", schema))
    return both.groupBy("category").agg(F.count("*").alias("n_rows"))


def checked_scan(spark: SparkSession, root: str) -> DataFrame:
    """Rows by category of a file with the columns that are asked for."""
    path, schema = _score_file(spark, root)
    if table(spark, root, "scores").limit(1).count():
        rows = files.read_checked_csv(spark, path, ["sample_id", "image_score"])
    else:
        rows = spark.createDataFrame([], schema)  # a file without rows is refused
    return rows.groupBy("category").agg(F.count("*").alias("n_rows"), F.count_distinct("sample_id").alias("n_samples"))


def folder_scan(spark: SparkSession, root: str) -> DataFrame:
    """A tree of images and masks named after the records."""
    base = _made(spark, "tree")
    r = records(spark, root).where("record_id is not null and category is not null and label is not null").select("record_id", "category", "split", "label")
    name = F.concat(F.format_string("%08d", "record_id"), F.lit(".png"))
    path = F.concat_ws("/", F.lit(base), "category", F.coalesce("split", F.lit("none")), F.when(F.col("label") == 1, "bad").otherwise("good"), name)
    masks = r.where("record_id % 2 = 0").select(F.concat_ws("/", F.lit(base), "category", F.lit("ground_truth"), name).alias("path"))
    placed(r.select(path.alias("path")).unionByName(masks).distinct().withColumn("content", F.lit(b"x")))
    found = files.dataset_from_config(spark, {"name": "visa_pcb", "root": base})
    return found.select("dataset", "category", "sample_id", "split", "label", text.file_name(F.col("mask_path")).alias("mask"))


def board_scan(spark: SparkSession, root: str) -> DataFrame:
    """Boards named after the records; some have templates and annotations, and a split list names a part of them."""
    base = _made(spark, "boards")
    r = records(spark, root).where("record_id is not null and category is not null").select("record_id", "category").distinct()
    stem = F.format_string("%08d", "record_id")
    kinds = F.array(
        F.concat_ws("/", F.lit(base), "category", F.concat(stem, F.lit("_test.jpg"))), F.when(F.col("record_id") % 3 == 0, F.concat_ws("/", F.lit(base), "category", F.concat(stem, F.lit("_temp.jpg")))),
        F.when(F.col("record_id") % 2 == 0, F.concat(F.lit(base), F.lit("/"), "category", F.lit("_not/"), stem, F.lit(".txt"))),
    )
    placed(r.select(F.explode(F.array_compact(kinds)).alias("path")).withColumn("content", F.lit(b"1,2,3,4,1\n")))
    listed = scratch_path(spark, "split_list")
    r.where("record_id % 5 <> 0").select(F.concat(stem, F.lit("_test.jpg"))).write.text(listed)
    found = files.dataset_from_config(spark, {"name": "deeppcb", "root": base, "split": "val", "split_file": listed})
    return found.select("dataset", "category", "sample_id", "split", "label", text.file_name(F.col("template_path")).alias("template"), text.file_name(F.col("box_path")).alias("boxes"))


def manifest_scan(spark: SparkSession, root: str) -> DataFrame:
    """Records by way of a manifest whose columns have other names; their labels are left out of every third."""
    r = table(spark, root, "dataset_records").select("record_id", "category", "sample_id", "split", "image_path", "label", "batch_no").distinct()
    r = r.where("trim(image_path) <> '' and trim(sample_id) <> ''")
    files.write_csv(
        r.select(F.concat_ws("#", "sample_id", "record_id").alias("name"), F.col("category").alias("class"), F.col("split").alias("phase"), F.col("image_path").alias("IMG_PATH"), F.when(F.col("batch_no") % 3 != 0, F.col("label")).alias("is_anomaly")),
        path := scratch_path(spark, "manifest"),
    )
    found = files.manifest_records(spark, path, "manifest", root="/data")
    return found.select("dataset", "category", "sample_id", "split", "label", text.relative_to(F.col("image_path"), "/data").alias("image_path"))


def array_scan(spark: SparkSession, root: str) -> DataFrame:
    """The scores of each image as an array of one row."""
    base = _made(spark, "arrays")

    def packed(pdf):
        import pandas as pd

        data = io.BytesIO()
        np.save(data, pdf.sort_values(["y", "x"])["score"].to_numpy(np.float32)[None, :])
        return pd.DataFrame({"path": [f"{base}/{pdf['img'].iloc[0]}.npy"], "content": [data.getvalue()]})

    px = pixels(spark, root).select("img", "x", "y", "score").where("score is not null")
    n = placed(px.groupBy("img").applyInPandas(packed, "path string, content binary"))
    if not n:
        return spark.createDataFrame([], "image_id string, y int, x int, score double")
    return files.read_arrays(spark, base).select("image_id", "y", "x", F.round(F.col("score").cast("double"), 4).alias("score"))


def component_scan(spark: SparkSession, root: str) -> DataFrame:
    """Images as views of few patches: the whole of two patches, and the left half of one; written, read and drawn."""
    s = pixels(spark, root).groupBy("img").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"))
    j = images(spark, root).select("img", "width", "height").join(s, "img")
    view = lambda i, x2, grid, scores: F.struct(F.lit(i).alias("component_ix"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), x2.cast("int").alias("x2"), F.col("height").cast("int").alias("y2"), F.lit(grid).alias("grid_w"), F.lit(1).alias("grid_h"), F.array(*scores).cast("array<float>").alias("scores"), F.lit("max").alias("fusion"))
    views = j.select(F.col("img").cast("string").alias("image_id"), F.explode(F.array(view(0, F.col("width"), 2, [F.col("low"), F.col("high")]), view(1, F.ceil(F.col("width") / 2), 1, [F.col("mean")]))).alias("v")).select("image_id", "v.*")
    files.write_components(views, path := scratch_path(spark, "components"))
    return files.rendered(files.read_components(spark, path)).select("image_id", "x", "y", F.round("score", 3).alias("score"))


def pixel_sink(spark: SparkSession, root: str) -> DataFrame:
    px = pixels(spark, root).select(F.col("img").cast("string").alias("image_id"), "y", "x", F.col("score").cast("float").alias("score"))
    files.write_pixels(px, path := scratch_path(spark, "pixels"))
    back = spark.read.schema(schemas.PIXELS).parquet(path)
    return back.groupBy("image_id").agg(F.count("*").alias("n_pixels"), F.round(F.sum(F.col("score").cast("double")), 2).alias("total"))


def metric_files(spark: SparkSession, root: str) -> DataFrame:
    """A file of metrics for each category, some of which lack one; and their summary."""
    base = _made(spark, "metrics")
    r = run_results(spark, root).groupBy("category").agg(F.sum("n_rows").alias("num_images"), F.round(F.avg("price"), 3).alias("image_auroc"), F.round(F.avg("balance"), 3).alias("b"))
    lacks = F.col("category").isin("BUILDING", "MACHINERY")
    r = r.select(F.concat(F.lit(base), F.lit("/"), "category", F.lit("/metrics.json")).alias("path"), F.to_json(F.struct("num_images", "image_auroc", F.when(~lacks, F.col("b")).alias("aupro"), F.when(~lacks, F.col("b")).alias("best_pixel_f1"))).cast("binary").alias("content"))
    if not placed(r):
        return spark.createDataFrame([], "category string, num_images long, image_auroc double, aupro double, best_pixel_f1 double")
    out = files.metric_summary(files.read_metrics(spark, [f"{base}/*/metrics.json"]))
    return out.select("category", "num_images", *[F.round(c, 6).alias(c) for c in ("image_auroc", "aupro", "best_pixel_f1")])


def synthetic_fixture(spark: SparkSession, root: str) -> DataFrame:
    return files.synthetic_images(spark).groupBy("sample_id", "split", "label").agg(F.count("*").alias("n_pixels"), F.sum("target").alias("n_target"), F.sum("r").alias("red"), F.sum("g").alias("green"), F.sum("b").alias("blue"))


QUERIES = {f.__name__: f for f in (csv_scan, optional_scan, checked_scan, folder_scan, board_scan, manifest_scan, array_scan, component_scan, pixel_sink, metric_files, synthetic_fixture)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_HAS = "list_has_any(string_split(lower({0}), '/'), {1})"
_SPLIT = " ".join(f"WHEN {_HAS.format('image_path', [s])} THEN '{text.SPLITS[s]}'" for s in text.SPLIT_PARTS)
_CATEGORY = " ".join(f"WHEN {_HAS.format('image_path', [c])} THEN '{c}'" for c in files.PCB_CATEGORIES)
_NAMES = " ".join(f"WHEN lower(phase) = '{k}' THEN '{v}'" for k, v in text.SPLITS.items())
_TEXT = ", ".join(f"nullif({c}, '') AS {c}" for c in ("run_id", "dataset", "sample_id", "category"))
ORACLE = {
    "csv_scan": f"SELECT DISTINCT score_id, {_TEXT}, label, round(CASE WHEN NOT isnan(image_score) THEN image_score END, 9) AS image_score, nullif(image_path, '') AS image_path FROM scores",
    "optional_scan": "SELECT nullif(category, '') AS category, count(*) AS n_rows FROM (SELECT DISTINCT score_id, run_id, dataset, sample_id, category, label, image_score, image_path FROM scores) GROUP BY 1",
    "checked_scan": "SELECT nullif(category, '') AS category, count(*) AS n_rows, count(DISTINCT nullif(sample_id, '')) AS n_samples FROM (SELECT DISTINCT score_id, run_id, dataset, sample_id, category, label, image_score, image_path FROM scores) GROUP BY 1",
    "folder_scan": f"WITH {RECORDS} SELECT DISTINCT 'visa_pcb' AS dataset, category, category || '/' || printf('%08d', record_id) AS sample_id, coalesce(split, 'all') AS split, CASE WHEN label = 1 THEN '1' ELSE '0' END AS label, CASE WHEN label = 1 AND record_id % 2 = 0 THEN printf('%08d', record_id) || '.png' END AS mask FROM records WHERE category IN ('pcb1', 'pcb2', 'pcb3', 'pcb4') AND label IS NOT NULL",
    "board_scan": f"WITH {RECORDS} SELECT DISTINCT 'deeppcb' AS dataset, category, printf('%08d_test', record_id) AS sample_id, 'val' AS split, '1' AS label, CASE WHEN record_id % 3 = 0 THEN printf('%08d_temp.jpg', record_id) END AS template, CASE WHEN record_id % 2 = 0 THEN printf('%08d.txt', record_id) END AS boxes FROM records WHERE category IS NOT NULL AND record_id % 5 <> 0",
    "manifest_scan": f"""WITH r AS (SELECT DISTINCT record_id, nullif(trim(category, {_BLANKS}), '') AS category, trim(sample_id || '#' || record_id, {_BLANKS}) AS name, nullif(trim(split, {_BLANKS}), '') AS phase, trim(image_path, {_BLANKS}) AS image_path, CASE WHEN batch_no % 3 <> 0 THEN label END AS label FROM dataset_records WHERE trim(image_path) <> '' AND trim(sample_id) <> ''),
      c AS (SELECT *, coalesce(category, CASE {_CATEGORY} END, 'unknown') AS cat FROM r)
      SELECT 'manifest' AS dataset, cat AS category, cat || '/' || name AS sample_id, coalesce(CASE {_NAMES} END, phase, CASE {_SPLIT} END, 'all') AS split, CASE WHEN label IN (0, 1) THEN label::VARCHAR WHEN {_HAS.format('image_path', list(text.ANOMALOUS_PARTS))} THEN '1' ELSE '0' END AS label, image_path FROM c""",
    "array_scan": f"WITH {PIXELS} SELECT img::VARCHAR AS image_id, 0 AS y, (row_number() OVER (PARTITION BY img ORDER BY y, x) - 1)::INT AS x, round(score::FLOAT::DOUBLE, 4) AS score FROM pixels WHERE score IS NOT NULL",
    "component_scan": f"WITH {PIXELS}, {IMAGES}, s AS (SELECT img, min(score)::FLOAT::DOUBLE AS low, max(score)::FLOAT::DOUBLE AS high, avg(score)::FLOAT::DOUBLE AS mean FROM pixels GROUP BY img), c AS (SELECT img, width, low, high, mean, unnest(range(width)) AS x, height FROM images JOIN s USING (img)), d AS (SELECT *, unnest(range(height)) AS y FROM c) SELECT img::VARCHAR AS image_id, x::INT AS x, y::INT AS y, round(greatest(CASE WHEN floor((x + 0.5) * 2 / width) = 0 THEN low ELSE high END, CASE WHEN x < ceil(width / 2.0) THEN mean END), 3) AS score FROM d",
    "pixel_sink": f"WITH {PIXELS} SELECT img::VARCHAR AS image_id, count(*) AS n_pixels, round(sum(score::FLOAT::DOUBLE), 2) AS total FROM pixels GROUP BY img",
    "metric_files": f"""WITH {RESULTS}, r AS (SELECT category, sum(n_rows)::BIGINT AS num_images, round(avg(price), 3) AS image_auroc, round(avg(balance), 3) AS b FROM results GROUP BY category), p AS (SELECT category, num_images, image_auroc, CASE WHEN category NOT IN ('BUILDING', 'MACHINERY') THEN b END AS aupro, CASE WHEN category IN ('BUILDING', 'MACHINERY') THEN 0 ELSE b END AS best_pixel_f1 FROM r)
      SELECT * FROM p UNION ALL SELECT 'mean', sum(num_images)::BIGINT, round(avg(image_auroc), 6), round(avg(aupro), 6), round(avg(best_pixel_f1), 6) FROM p""",
    "synthetic_fixture": """WITH s AS (SELECT * FROM (VALUES ('train_000', 'train', 0), ('train_001', 'train', 0), ('train_002', 'train', 0), ('test_good', 'test', 0), ('test_bad', 'test', 1)) v(sample_id, split, label)), p AS (SELECT *, label = 1 AND x BETWEEN 36 AND 49 AND y BETWEEN 28 AND 41 AS hit, x % 16 < 4 OR y % 16 < 3 AS track FROM s, (SELECT unnest(range(64)) AS x), (SELECT unnest(range(64)) AS y))
      SELECT sample_id, split, label, count(*) AS n_pixels, count(*) FILTER (hit) AS n_target, sum(CASE WHEN hit THEN 230 WHEN track THEN 190 ELSE 20 END)::BIGINT AS red, sum(CASE WHEN hit THEN 60 WHEN track THEN 140 ELSE 90 END)::BIGINT AS green, sum(CASE WHEN hit THEN 50 WHEN track THEN 60 ELSE 40 END)::BIGINT AS blue FROM p GROUP BY ALL""",
}
