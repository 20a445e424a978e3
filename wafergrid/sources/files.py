"""Scans and sinks of the file formats that runs exchange: CSV, JSON, text lines, folders of images, heatmap arrays."""

from __future__ import annotations

import csv
import io
import json
import os
import re
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafergrid.functions import text
from wafergrid.functions.paths import once
from wafergrid.operators.joins import last_of_each
from wafergrid.operators.stats import with_mean_row
from wafergrid.session import _file_system, path_exists, shuffle_width, written
from wafergrid.sources import schemas

#: Usual categories, and the names that a manifest's column of images goes by.
PCB_CATEGORIES = ("pcb1", "pcb2", "pcb3", "pcb4")
IMAGE_COLUMNS = ("image_path", "img_path", "path", "image", "filename", "file", "filepath")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, *, line_ends: bool = True) -> DataFrame:
    """A CSV file or folder of such files, with a header; without a schema every column is text. Quoted line ends stay in a value; where there are none, ``line_ends=False`` lets a large file be read in parts."""
    r = spark.read.option("header", True).option("multiLine", line_ends).option("escape", '"')
    return (r.schema(schema).option("enforceSchema", False) if schema else r).csv(path)


def read_optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """No rows if the file isn't there, on whatever file system it is looked for."""
    return read_csv(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_checked_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A CSV file with unique column names, the required ones among them, and at least one row; else ValueError."""
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    names = [c.strip() for c in next(csv.reader([first[0][0].lstrip("\ufeff").rstrip("\r")]), [])] if first else []
    if len(set(names)) != len(names):
        raise ValueError(f"{path}: repeated column names")
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"{path}: missing columns {missing}")
    df = read_csv(spark, path)
    if not df.limit(1).count():
        raise ValueError(f"{path}: no rows")
    return df


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, line_no, x1, ..., class_name) of annotation files, one line a box; blank lines are passed over, a malformed one fails when it is read. The image is the file's stem; without any file there are no boxes."""
    if not any(c in path for c in "*?[{") and not path_exists(spark, path):
        return spark.createDataFrame([], schemas.BOXES)
    lines = spark.read.text(path, wholetext=True).select(text.stem(F.col("_metadata.file_path")).alias("image_id"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where("trim(line) <> ''")
    box = text.annotation_box(F.col("line"))
    bad = F.raise_error(F.concat(F.lit("malformed annotation in "), "image_id", F.lit(", line "), (F.col("n") + 1).cast("string"))).cast(T.StructType(schemas.BOXES.fields[2:]))
    return lines.select("image_id", (F.col("n") + 1).alias("line_no"), F.coalesce(box, bad).alias("b")).select("image_id", "line_no", "b.*")


def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id): every way in which the tokens of a split list may name a sample. Blank lines and those that start with # are passed over; of a line the tokens between blanks count."""
    lines = spark.read.text(path).where("trim(value) <> '' and not trim(value) like '#%'")
    token = lines.select(F.explode(F.split(F.trim("value"), r"[\s,]+")).alias("t")).where("t <> ''")
    for name, value in (("s", text.stem(F.col("t"))), ("bare", text.without_marker(F.col("s"))), ("v", text.id_variants(F.col("t"), F.col("s"), F.col("bare")))):
        token = once(token, name, value)  # step by step: as one expression it is too long to compile
    return token.select(F.explode("v").alias("sample_id")).distinct()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, folder BOOLEAN) of what lies in each folder, without names that Spark's readers pass over."""
    import pyarrow.fs as pafs

    hidden = lambda n: n.startswith(".") or n.startswith("_") and "=" not in n or n.endswith("._COPYING_")
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, at = (pafs.LocalFileSystem(), uri.removeprefix("file:")) if uri.startswith("file:/") else pafs.FileSystem.from_uri(uri)  # names of local files may hold any character
            found = [f for f in fs.get_file_info(pafs.FileSelector(at)) if not hidden(f.base_name)]
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{uri}/{f.base_name}" for f in part], pa.string()), "folder": pa.array([f.type == pafs.FileType.Directory for f in part], pa.bool_())})


def list_files(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """(path): files below a folder with one of the suffixes; contents aren't read.

    Folders are listed level by level in tasks, a folder in one, and what they hold is written: the driver sees no
    file and no folder but the root (or those that match it, if it is a pattern). A root that isn't there fails.
    """
    fs, at = _file_system(spark, root)
    roots = [str(f.getPath()) for f in (fs.globStatus(at) or [])]
    if not roots:
        raise FileNotFoundError(f"{root}: no such folder")
    level = spark.createDataFrame([(r.rstrip("/"), True) for r in roots], "path string, folder boolean")
    files = None
    while True:
        below = level.where("folder").select("path")
        below = below.repartition(shuffle_width(spark), "path") if files is not None else below
        level = written(below.mapInArrow(_listed, "path string, folder boolean"), "listing")
        files = level if files is None else files.unionByName(level)
        if not level.where("folder").limit(1).count():
            break
    return files.where("not folder").select("path").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def image_records(spark: SparkSession, root: str, dataset: str, categories: Sequence[str]) -> DataFrame:
    """Records of a folder tree: category, split and label by parts of the path, a mask by category and stem.

    Files below mask folders are no images. Only anomalous images have a mask: that of their own stem, else that of their
    stem with ``_mask`` at its end, in any case; of several of one name the last in path order. Files without a category are left out; a split that isn't told is 'all'.
    """
    files = list_files(spark, root, text.IMAGE_SUFFIXES)
    is_mask, category = text.has_part(F.col("path"), text.MASK_PARTS), text.path_category(F.col("path"), categories)
    files = files.select("path", is_mask.alias("is_mask"), category.alias("category"), text.stem(F.col("path")).alias("stem")).where("category is not null")
    files = files.withColumn("loose", F.regexp_replace(F.lower("stem"), "_mask$", ""))
    masks = files.where("is_mask")
    exact, loose = (masks.groupBy("category", c).agg(F.max("path").alias(name)) for c, name in (("stem", "exact"), ("loose", "near")))
    out = files.where("not is_mask").join(exact, ["category", "stem"], "left").join(loose, ["category", "loose"], "left").withColumn("mask", F.coalesce("exact", "near"))
    label = text.label_value(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("path"))
    return out.select(
        F.lit(dataset).alias("dataset"), "category", F.concat("category", F.lit("/"), text.stem(F.col("path"))).alias("sample_id"), F.coalesce(text.path_split(F.col("path")), F.lit("all")).alias("split"),
        F.col("path").alias("image_path"), label.cast("string").alias("label"), F.when(label == 1, F.col("mask")).alias("mask_path"),
        *[F.lit(None).cast("string").alias(c) for c in ("box_path", "template_path", "metadata_json")],
    )


def board_records(spark: SparkSession, root: str, dataset: str = "deeppcb", split: str = "all", split_file: str | None = None) -> DataFrame:
    """Records of boards with templates: test images, with the first template and annotation file that exist among the candidates.

    Every board counts as anomalous; its category is the parent folder. With a split list only images that it names by
    stem, file name or path are kept (see ``read_split_list``); ``split`` is the name that the records get.
    """
    every, noted = list_files(spark, root, ("jpg", "jpeg", "png", "bmp", "txt")), F.lower("path").endswith(".txt")
    images, notes = every.where(~noted), every.where(noted)
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    test = images.where(text.looks_like_test(F.col("path"))).withColumn("folder", folder("path"))
    if split_file is not None:
        names = F.array(text.stem(F.col("path")), text.file_name(F.col("path")), "path", F.regexp_replace("path", "^file:(//)?", ""))
        named = test.select("path", F.explode(F.array_distinct(names)).alias("sample_id")).join(read_split_list(spark, split_file), "sample_id").select("path")
        test = test.join(named, "path", "left_semi")
    other = images.select(folder("path").alias("folder"), text.stem(F.col("path")).alias("s"), F.col("path").alias("found"))

    def first(stems: Column, folders: Sequence[Column], there: DataFrame, name: str) -> DataFrame:
        c = once(test.select("path", "folder"), "stems", stems)  # step by step: as one expression it is too long to compile
        within = lambda f: F.transform("stems", lambda s: F.struct(f.alias("folder"), s.alias("s")))
        places = F.concat(*map(within, folders))
        c = once(c, "places", places).select("path", F.posexplode("places").alias("n", "c")).select("path", "n", "c.folder", "c.s")
        return c.join(there, ["folder", "s"]).groupBy("path").agg(F.min_by("found", "n").alias(name))

    own = F.col("folder")
    templates = first(text.template_stems(F.col("path")), [own], other, "template_path")
    noted = notes.select(folder("path").alias("folder"), text.stem(F.col("path")).alias("s"), F.col("path").alias("found"))
    boxes = first(text.annotation_stems(F.col("path")), [own, F.concat("folder", F.lit("_not"))], noted, "box_path")
    out = test.join(templates, "path", "left").join(boxes, "path", "left")
    return out.select(
        F.lit(dataset).alias("dataset"), text.file_name(F.col("folder")).alias("category"), text.stem(F.col("path")).alias("sample_id"), F.lit(split).alias("split"), F.col("path").alias("image_path"),
        F.lit("1").alias("label"), F.lit(None).cast("string").alias("mask_path"), "box_path", "template_path", F.lit(None).cast("string").alias("metadata_json"),
    )


def _without_missing(df: DataFrame, column: str) -> DataFrame:
    """``df`` with NULL where a path names no file that the workers see; paths of another scheme than file: stay."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(at).to_pylist()
            local = [p if p is None else re.sub("^file:(//)?", "", p) for p in paths]
            kept = pa.array([p if p and ("://" in q or os.path.exists(q)) else None for p, q in zip(paths, local)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], kept, *batch.columns[at + 1 :]], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def manifest_records(spark: SparkSession, path: str, dataset: str, root: str | None = None, categories: Sequence[str] = PCB_CATEGORIES) -> DataFrame:
    """Records of a manifest whose columns go by several names; label by word, mask or path.

    Relative paths lie below ``root``, which is the manifest's folder if not given; a mask that isn't there is NULL. A
    category that isn't given is the first of ``categories`` in the image's path, else 'unknown'; ids begin with it. A
    row without an image fails with its number, counted from 2 with the header as 1.
    """
    m = read_csv(spark, path).withColumn("__row", F.monotonically_increasing_id() + 2)  # quoted line ends: a file is read in one part
    if not {c.lower() for c in m.columns} & set(IMAGE_COLUMNS):
        raise ValueError(f"{path}: no column of {list(IMAGE_COLUMNS)}")
    base = (root if root is not None else os.path.dirname(path)).rstrip("/") + "/"

    def resolved(c: Column) -> Column:
        home = F.concat(F.lit(os.path.expanduser("~")), F.substr(c, F.lit(2)))
        return F.when(c.rlike("^~(/|$)"), home).when(c.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), c).otherwise(F.concat(F.lit(base), c))

    given = text.first_value(m, IMAGE_COLUMNS)
    image = resolved(F.coalesce(given, F.raise_error(F.concat(F.lit(f"{path}, row "), F.col("__row").cast("string"), F.lit(": no image path"))).cast("string")))
    mask = resolved(text.first_value(m, ["mask_path", "gt_path", "ground_truth", "mask", "annotation"]))
    label = text.label_value(text.first_value(m, ["label", "is_anomaly", "anomaly", "target", "defect"]), mask, image)
    category = F.coalesce(text.first_value(m, ["category", "object", "object_type", "class", "cls"]), text.path_category(image, categories), F.lit("unknown"))
    split = text.first_value(m, ["split", "phase", "subset", "set"])
    sample = F.coalesce(text.first_value(m, ["sample_id", "id", "name"]), text.stem(image))
    out = m.select(
        F.lit(dataset).alias("dataset"), category.alias("category"), F.concat(category, F.lit("/"), sample).alias("sample_id"),
        F.coalesce(text.split_name(split), split, text.path_split(image), F.lit("all")).alias("split"), image.alias("image_path"), label.cast("string").alias("label"), mask.alias("mask_path"),
        *[F.lit(None).cast("string").alias(c) for c in ("box_path", "template_path", "metadata_json")],
    )
    return _without_missing(out, "mask_path")


#: The known kinds of data set, by the name a configuration gives.
DATASETS = {"visa_pcb": image_records, "deeppcb": board_records, "manifest": manifest_records}


def dataset_from_config(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """Records of the data set that ``config`` names: ``name``, ``root``, and for folder trees and manifests ``categories``.

    Of a manifest ``root`` is the file, or with ``manifest_csv`` for the file the folder of its relative paths; given
    ``categories`` leave out all others. Boards take ``split`` and ``split_file``.
    """
    name = config.get("name")
    if name == "visa_pcb":
        return image_records(spark, str(config["root"]), "visa_pcb", list(config.get("categories", PCB_CATEGORIES)))
    if name == "deeppcb":
        listed = config.get("split_file")
        return board_records(spark, str(config["root"]), split=str(config.get("split", "all")), split_file=str(listed) if listed else None)
    if name == "manifest":
        root, file, wanted = str(config["root"]), config.get("manifest_csv"), config.get("categories")
        out = manifest_records(spark, str(file or root), str(config.get("dataset", "manifest")), root if file else None, list(wanted or PCB_CATEGORIES))
        return out.where(F.col("category").isin(list(wanted))) if wanted else out
    raise ValueError(f"unknown data set {name!r}; known are {sorted(DATASETS)}")


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header, NULL as an empty field."""
    df.select(*(columns or df.columns)).write.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(df: DataFrame, path: str, folder: str) -> None:
    """As ``write_csv``, with paths below ``folder`` made relative to it."""
    write_csv(df.select(*[text.relative_to(F.col(c), folder).alias(c) if c.endswith("_path") else c for c in df.columns]), path)


def read_metrics(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, category, metrics...) of JSON files of one object each; missing metrics are NULL."""
    fields = T.StructType(schemas.METRICS.fields[2:])
    m = spark.read.schema(fields).option("multiLine", True).json(list(paths)).withColumn("path", F.col("_metadata.file_path"))
    return m.select("path", text.category_of(F.col("path")).alias("category"), *fields.fieldNames())


def write_json(path: str, payload: Mapping[str, object]) -> None:
    """A small JSON object with sorted keys; readers see the old file or the new one, never a part."""
    data = json.dumps(payload, sort_keys=True, indent=2, allow_nan=False) + "\n"
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    temp = target.with_name(f".{target.name}.{os.getpid()}")
    with temp.open("w", encoding="utf-8") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, target)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, score) of 2-D arrays in NPY files or NPZ files of one array; other contents fail when they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if isinstance(a, np.lib.npyio.NpzFile):
                    if len(a.files) != 1:
                        raise ValueError(f"{name}: {len(a.files)} arrays, one is expected")
                    a = a[a.files[0]]
                if a.ndim != 2 or not a.size or not np.isfinite(a).all():
                    raise ValueError(f"{name}: not a finite array of two dimensions")
                y, x = np.indices(a.shape, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([name] * a.size), "y": y.ravel(), "x": x.ravel(), "score": pa.array(a.ravel().astype(np.float32))})

    files = spark.read.format("binaryFile").load(path).select(text.stem(F.col("path")).alias("image_id"), "content")
    return files.mapInArrow(run, "image_id string, y int, x int, score float")


def read_masks(spark: SparkSession, path: str, threshold: int = 0) -> DataFrame:
    """(image_id, y, x) of the pixels of mask images that are brighter than ``threshold``. Needs Pillow on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from PIL import Image
        except ImportError as e:
            raise RuntimeError("reading image files needs Pillow") from e
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y, x = np.nonzero(np.asarray(Image.open(io.BytesIO(content)).convert("L")) > threshold)
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([name] * len(y), pa.string()), "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32())})

    files = spark.read.format("binaryFile").load(path).select(text.stem(F.col("path")).alias("image_id"), "content")
    return files.mapInArrow(run, "image_id string, y int, x int")


def write_pixels(df: DataFrame, path: str) -> None:
    """Pixels as Parquet, those of an image together and row by row."""
    df.select(*schemas.PIXELS.fieldNames()).repartition("image_id").sortWithinPartitions("image_id", "y", "x").write.parquet(path)


def write_components(df: DataFrame, path: str) -> None:
    """Views of images as patch grids with their boxes, small beside rendered pixels; see ``rendered``. A view whose grid is empty or not of the size stated, whose box is empty, or whose fusion is neither 'max' nor 'mean' fails, and so does one with a NULL."""
    df = df.select(*schemas.COMPONENTS.fieldNames())
    whole = F.coalesce((F.size("scores") > 0) & (F.size("scores") == F.col("grid_w") * F.col("grid_h")) & F.col("fusion").isin("max", "mean") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    named = F.concat(F.lit("view "), F.coalesce(F.col("component_ix").cast("string"), F.lit("?")), F.lit(" of "), F.coalesce("image_id", F.lit("?")), F.lit(": grid, box or fusion"))
    scores = F.when(whole, F.col("scores")).otherwise(F.raise_error(named).cast("array<float>"))  # in a column that is kept
    df.withColumn("scores", scores).write.parquet(path)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """Views as ``write_components`` writes them; a table of other columns or types raises ValueError."""
    df = spark.read.parquet(path)
    kinds = {f.name: f.dataType.simpleString() for f in schemas.COMPONENTS.fields}
    if dict(df.dtypes) != kinds:
        raise ValueError(f"{path}: columns {dict(df.dtypes)}, {kinds} are expected")
    return df


def metric_summary(metrics: DataFrame) -> DataFrame:
    """(category, num_images, metrics...) by category, and a row 'mean' with the sum of images and the means of the metrics: a metric that a file lacks is 0, but ``aupro`` stays NULL and out of the mean."""
    names = schemas.METRICS.fieldNames()[3:]
    filled = metrics.select("category", F.coalesce("num_images", F.lit(0)).alias("num_images"), *[F.col(n) if n == "aupro" else F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    return with_mean_row(filled, "category", ["num_images"], names)


def rendered(components: DataFrame) -> DataFrame:
    """(image_id, x, y, score): each view's grid at the size of its box by the nearest cell, put together by the image's fusion."""
    v = components.withColumn("y", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1))).withColumn("x", F.explode(F.sequence(F.col("x1"), F.col("x2") - 1)))
    gx = F.least(F.floor((F.col("x") - F.col("x1") + 0.5) * F.col("grid_w") / (F.col("x2") - F.col("x1"))), F.col("grid_w") - 1)
    gy = F.least(F.floor((F.col("y") - F.col("y1") + 0.5) * F.col("grid_h") / (F.col("y2") - F.col("y1"))), F.col("grid_h") - 1)
    v = v.select("image_id", "x", "y", "fusion", F.get("scores", (gy * F.col("grid_w") + gx).cast("int")).cast("double").alias("s"))
    g = v.groupBy("image_id", "x", "y").agg(F.max("s").alias("top"), F.avg("s").alias("mean"), F.max("fusion").alias("fusion"))
    return g.select("image_id", "x", "y", F.when(F.col("fusion") == "max", F.col("top")).otherwise(F.col("mean")).alias("score"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return last_of_each(df, key, order)


def synthetic_images(spark: SparkSession, side: int = 64) -> DataFrame:
    """(sample_id, split, label, x, y, r, g, b, target): four made images, three normal ones for training and of two for testing one with a scratch at (36, 28)-(49, 41)."""
    rows = [("train_000", "train", 0), ("train_001", "train", 0), ("train_002", "train", 0), ("test_good", "test", 0), ("test_bad", "test", 1)]
    s = spark.createDataFrame(rows, "sample_id string, split string, label int")
    s = s.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    hit = (F.col("label") == 1) & F.col("x").between(36, 49) & F.col("y").between(28, 41)
    track = (F.col("x") % 16 < 4) | (F.col("y") % 16 < 3)
    r, g, b = (F.when(hit, v[0]).when(track, v[1]).otherwise(v[2]) for v in ((230, 190, 20), (60, 140, 90), (50, 60, 40)))
    return s.select("sample_id", "split", "label", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), hit.cast("int").alias("target"))
