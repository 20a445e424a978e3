"""Queries on paths, labels, ids and lines of text, and descriptions of the data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.functions import text
from wafergrid.functions.paths import with_stored_place
from wafergrid.operators import grids, lineage
from wafergrid.plans._views import RECORDS, RESULTS, records, run_results
from wafergrid.sources.tables import table

CATEGORIES = ["pcb1", "pcb2", "pcb3", "pcb4", "pcb5", "deeppcb"]
STORE = "/srv/pcblab/store"


def describe_groupings(spark: SparkSession, root: str) -> DataFrame:
    """Counts by category, by split and by label in one pass."""
    g = records(spark, root).select("category", "split", F.col("label").cast("string").alias("label"))
    g = g.groupingSets([[F.col("category")], [F.col("split")], [F.col("label")]], "category", "split", "label").agg(F.count("*").alias("n_rows"), F.grouping_id().alias("g"))
    return g.select(F.element_at(F.create_map(F.lit(3), F.lit("category"), F.lit(5), F.lit("split"), F.lit(6), F.lit("label")), F.col("g").cast("int")).alias("kind"), F.coalesce("category", "split", "label").alias("value"), "n_rows")


def split_counts(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root).groupBy("fold_id", "fold_split").agg(F.count("*").alias("n_rows"))


def record_filter(spark: SparkSession, root: str) -> DataFrame:
    """Normal train records of two categories."""
    return records(spark, root).where(F.col("category").isin("pcb1", "pcb2") & (F.col("split") == "train") & (F.col("label") == 0)).select("record_id", "category", "sample_id")


def manifest_selection(spark: SparkSession, root: str) -> DataFrame:
    """Test rows of a fold (compared as text), by label and sample, the first 50."""
    r = records(spark, root).where((F.col("dataset") == "visa_pcb") & (F.col("category") == "pcb1") & (F.col("fold_id") == "0") & (F.col("split") == "test") & F.col("label").isin(0, 1))
    return r.orderBy("label", "sample_id", "record_id").limit(50).select("record_id", "label", "sample_id")


def alias_coalesce(spark: SparkSession, root: str) -> DataFrame:
    r = records(spark, root)
    return r.select("record_id", text.first_value(r, ["Mask_Path", "BOX_PATH", "template_path", "not_there", "image_path"]).alias("first_path"))


def label_vocab(spark: SparkSession, root: str) -> DataFrame:
    word = F.when(F.col("batch_no") % 3 == 0, F.when(F.col("label") == 1, " Defect ").when(F.col("label") == 0, "GOOD"))
    return records(spark, root).select("record_id", text.label_value(word, F.col("mask_path"), F.col("image_path")).alias("label"))


def path_inference(spark: SparkSession, root: str) -> DataFrame:
    p = F.regexp_replace("image_path", "Anomaly/", "anomaly/test/")
    r = records(spark, root).select("record_id", p.alias("p"), "mask_path")
    return r.select("record_id", text.path_category(F.col("p"), CATEGORIES).alias("category"), text.path_split(F.col("p")).alias("split"), text.has_part(F.col("mask_path"), text.MASK_PARTS).alias("mask_hint"))


def file_stems(spark: SparkSession, root: str) -> DataFrame:
    p = F.regexp_replace("image_path", r"(\.\w+)$", "_test$1")
    r = records(spark, root).where("image_path is not null").select("record_id", p.alias("p"))
    return r.select("record_id", text.stem(F.col("p")).alias("stem"), text.looks_like_test(F.col("p")).alias("is_test"), F.array_join(text.annotation_stems(F.col("p")), ",").alias("annotations"), F.array_join(text.template_stems(F.col("p")), ",").alias("templates"))


def split_id_semi(spark: SparkSession, root: str) -> DataFrame:
    """Records named by a split list, in any of the ways a list may name them."""
    listed = records(spark, root).where("batch_no = 3 and sample_id is not null").select(F.explode(text.split_id_variants(F.concat("sample_id", F.lit("_test.jpg")))).alias("sample_id"))
    return records(spark, root).select("record_id", "sample_id").join(listed, "sample_id", "left_semi")


def parse_annotations(spark: SparkSession, root: str) -> DataFrame:
    """Lines of five numbers in the texts, by class."""
    lines = table(spark, root, "documents").where("text is not null").select(F.explode(F.split("text", r"\r?\n")).alias("line"))
    box = lines.where(F.col("line").rlike(r"^\s*\d+[\s,]+\d")).select(text.annotation_box(F.col("line")).alias("b")).where("b is not null")
    return box.groupBy("b.class_id", "b.class_name").agg(F.count("*").alias("n_boxes"), F.sum("b.x1").alias("sum_x1"), F.sum("b.y2").alias("sum_y2"))


def box_areas(spark: SparkSession, root: str) -> DataFrame:
    """Crops cut to an image of 1,000 by 800."""
    n = F.split(F.regexp_extract("view_box", r"^crop:(.*)$", 1), ",")
    c = table(spark, root, "feature_cache").where("view_box like 'crop:%'").select("cache_key", *[n[i].cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]).distinct()
    return c.select("cache_key", grids.clipped_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(1000), F.lit(800))[4].alias("area"))


def boxes_raster(spark: SparkSession, root: str) -> DataFrame:
    """Cells of 32 pixels that the crops of a sample cover."""
    n = F.split(F.regexp_extract("view_box", r"^crop:(.*)$", 1), ",")
    c = table(spark, root, "feature_cache").where("view_box like 'crop:%'").select("sample_id", *[(n[i].cast("double") / 32).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    return grids.boxes_to_cells(c, "sample_id").groupBy("sample_id").agg(F.count("*").alias("n_cells"))


def content_boxes(spark: SparkSession, root: str) -> DataFrame:
    b = grids.content_box(F.col("source_width"), F.col("source_height"), 518)
    w, h = grids.prompt_shape(F.col("source_width"), F.col("source_height"), 256)
    s = table(spark, root, "feature_cache").select("source_width", "source_height").distinct()
    return s.select("source_width", "source_height", *[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))], w.alias("prompt_width"), h.alias("prompt_height"))


def class_ids_json(spark: SparkSession, root: str) -> DataFrame:
    j = F.concat(F.lit('{"class_ids":["'), F.col("category"), F.lit('","'), F.col("dataset"), F.lit('","'), F.col("category"), F.lit('"]}'))
    return records(spark, root).select("record_id", F.array_join(text.class_ids(j), "+").alias("class_ids"))


def safe_filename(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root).where("sample_id is not null").select("sample_id", text.safe_filename(F.col("sample_id")).alias("safe")).distinct()


def method_cascade(spark: SparkSession, root: str) -> DataFrame:
    p = F.regexp_replace("file_path", "_multi", "_ms768")
    f = table(spark, root, "artifact_files").select(F.regexp_extract(p, r"outputs/+[^/]+/([^/]+)/", 1).alias("folder"))
    return f.groupBy(text.method_of(F.regexp_replace("folder", "__.*$", "")).alias("method"), text.category_of(F.concat("folder", F.lit("/metrics.json"))).alias("category")).agg(F.count("*").alias("n_files"))


def run_id_format(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "run_specs")
    made = lineage.run_id(F.col("method"), F.col("category"), F.col("fold_id"), F.col("k"), F.col("seed"), F.col("variant"))
    return r.select("run_id", (made == F.col("run_id")).alias("as_made"), F.col("run_id").rlike(r"^[a-z0-9_]+__fold\d+__k\d+__seed\d+(__[a-z0-9_]+)?$").alias("well_formed")).distinct()


def crop_size_lists(spark: SparkSession, root: str) -> DataFrame:
    """Run lengths of the payloads, written as lists of whole numbers."""
    n = text.whole_numbers(F.col("payload"))
    return table(spark, root, "artifact_files").where("payload is not null").groupBy("size_bytes").agg(F.sum(F.size(n)).alias("n_runs"), F.sum(F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


def markdown_table(spark: SparkSession, root: str) -> DataFrame:
    g = run_results(spark, root).groupBy("method", "k").agg(F.avg("price").alias("price"), F.avg(F.when(F.col("method") != "2-HIGH", F.col("balance"))).alias("balance"))
    return g.select("method", "k", text.markdown_row(F.col("method"), F.col("k").cast("string"), text.fixed_point(F.col("price"), 2), text.fixed_point(F.col("balance"), 2)).alias("line"))


def private_path_scan(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "scores").select(F.explode(F.array("image_path", "mask_path", "heatmap_path", "debug_path")).alias("p")).where("p is not null and p <> ''")
    return s.groupBy(text.exposes_private_path(F.col("p")).alias("private")).agg(F.count("*").alias("n_paths"))


def relative_paths(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "artifact_files").select("file_id", text.relative_to(F.col("file_path"), STORE).alias("path")).distinct()


def stored_places(spark: SparkSession, root: str) -> DataFrame:
    roots = table(spark, root, "run_specs").groupBy("run_id").agg(F.min("output_root").alias("output_root"))
    s = table(spark, root, "scores").select("score_id", "run_id", "heatmap_path").distinct().join(roots, "run_id", "left")
    return with_stored_place(s, "heatmap_path", "output_root", "place", store=STORE).select("score_id", "place")


def number_formats(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "mask_scores").select("mask_row_id", "sam2_to_anomaly_area_ratio", "mask_iou").distinct()
    inf = F.col("sam2_to_anomaly_area_ratio") == float("inf")
    return m.select("mask_row_id", F.when(inf, text.fixed_point(F.col("sam2_to_anomaly_area_ratio"))).otherwise("finite").alias("ratio"), F.round(text.null_for_nan(F.col("mask_iou")), 6).alias("mask_iou"))


QUERIES = {
    f.__name__: f
    for f in (
        describe_groupings, split_counts, record_filter, manifest_selection, alias_coalesce, label_vocab, path_inference, file_stems, split_id_semi, parse_annotations, box_areas, boxes_raster, content_boxes,
        class_ids_json, safe_filename, method_cascade, run_id_format, crop_size_lists, markdown_table, private_path_scan, relative_paths, stored_places, number_formats,
    )
}

_R = f"WITH {RECORDS}"
_B = "lower({0}) IS NOT NULL AND list_has_any(string_split(lower({0}), '/'), {1})"


def place_sql(path: str, base: str) -> str:
    """The stored place of a path, in steps; nested so that each step reads the one before."""
    p = f"nullif(trim(replace({path}, chr(92), '/'), ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '')"
    p = f"(CASE WHEN contains({p}, '%') THEN url_decode(replace({p}, '+', '%2B')) ELSE {p} END)"
    p = f"regexp_replace(regexp_replace({p}, '^file:/*/', '/'), '^(\\./+)+', '')"
    p = f"(CASE WHEN starts_with({p}, '/') OR starts_with({p}, 'outputs/') THEN {p} ELSE {base} || '/' || {p} END)"
    p = f"regexp_replace({p}, '/(\\.?/)+', '/', 'g')"
    p = f"regexp_replace({p}, '[^/]+/\\.\\./', '', 'g')"
    return f"(CASE WHEN starts_with({p}, '{STORE}/') THEN substr({p}, {len(STORE) + 2}) WHEN NOT starts_with({p}, '/') THEN {p} END)"


_BOX = "regexp_split_to_array(regexp_extract(view_box, '^crop:(.*)$', 1), ',')"
_STEM = "regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '\\.[^.]*$', '')"
ORACLE = {
    "describe_groupings": f"{_R} SELECT 'category' AS kind, category AS value, count(*) AS n_rows FROM records GROUP BY ALL UNION ALL SELECT 'split', split, count(*) FROM records GROUP BY ALL UNION ALL SELECT 'label', label::VARCHAR, count(*) FROM records GROUP BY ALL",
    "split_counts": f"{_R} SELECT fold_id, fold_split, count(*) AS n_rows FROM records GROUP BY ALL",
    "record_filter": f"{_R} SELECT record_id, category, sample_id FROM records WHERE category IN ('pcb1', 'pcb2') AND split = 'train' AND label = 0",
    "manifest_selection": f"{_R} SELECT record_id, label, sample_id FROM records WHERE dataset = 'visa_pcb' AND category = 'pcb1' AND fold_id = '0' AND split = 'test' AND label IN (0, 1) ORDER BY label, sample_id, record_id LIMIT 50",
    "alias_coalesce": f"{_R} SELECT record_id, coalesce(nullif(trim(mask_path), ''), nullif(trim(box_path), ''), nullif(trim(template_path), ''), nullif(trim(image_path), '')) AS first_path FROM records",
    "label_vocab": f"{_R} SELECT record_id, CASE WHEN batch_no % 3 = 0 AND label IN (0, 1) THEN label WHEN trim(mask_path) <> '' THEN 1 WHEN {_B.format('image_path', list(text.ANOMALOUS_PARTS))} THEN 1 ELSE 0 END AS label FROM records",
    "path_inference": f"{_R}, p AS (SELECT record_id, replace(image_path, 'Anomaly/', 'anomaly/test/') AS p, mask_path FROM records) SELECT record_id, CASE {' '.join(f'WHEN {_B.format(chr(112), [c])} THEN {chr(39)}{c}{chr(39)}' for c in CATEGORIES)} END AS category, CASE {' '.join(f'WHEN {_B.format(chr(112), [s])} THEN {chr(39)}{text.SPLITS[s]}{chr(39)}' for s in text.SPLIT_PARTS)} END AS split, coalesce({_B.format('mask_path', list(text.MASK_PARTS))}, false) AS mask_hint FROM p",
    "file_stems": f"{_R}, s AS (SELECT record_id, {_STEM} AS s FROM records WHERE image_path IS NOT NULL) SELECT record_id, s || '_test' AS stem, true AS is_test, s || '_test,' || trim(s, '_-') AS annotations, s || '_temp,' || s || '_template,' || s || '_tpl' AS templates FROM s",
    "split_id_semi": f"{_R}, l AS (SELECT sample_id || '_test.jpg' AS t, regexp_extract(sample_id, '([^/]*)$', 1) || '_test' AS s FROM records WHERE batch_no = 3 AND sample_id IS NOT NULL), v AS (SELECT t AS v FROM l UNION SELECT s || '.jpg' FROM l UNION SELECT s FROM l UNION SELECT trim(regexp_replace(s, '_test$', ''), '_-') FROM l UNION SELECT trim(regexp_replace(s, '_test$', ''), '_-') || '_test' FROM l) SELECT record_id, sample_id FROM records WHERE sample_id IN (SELECT v FROM v)",
    "parse_annotations": "WITH l AS (SELECT unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents WHERE text IS NOT NULL), p AS (SELECT list_filter(regexp_split_to_array(line, '[,\\s]'), lambda x: x <> '') AS p FROM l WHERE regexp_matches(line, '^\\s*\\d+[\\s,]+\\d')), b AS (SELECT list_transform(p, lambda x: TRY_CAST(x AS DOUBLE)) AS b FROM p WHERE len(p) = 5), g AS (SELECT b, CAST(trunc(b[5]) AS INT) AS class_id FROM b WHERE len(list_filter(b, lambda x: x IS NULL)) = 0) SELECT class_id, coalesce(['open', 'short', 'mousebite', 'spur', 'spurious_copper', 'pin_hole'][class_id], 'class_' || class_id) AS class_name, count(*) AS n_boxes, sum(b[1]) AS sum_x1, sum(b[4]) AS sum_y2 FROM g GROUP BY ALL",
    "box_areas": f"WITH c AS (SELECT DISTINCT cache_key, list_transform({_BOX}, lambda x: x::DOUBLE) AS b FROM feature_cache WHERE view_box LIKE 'crop:%') SELECT cache_key, greatest(least(b[3], 1000) - least(b[1], 1000), 0) * greatest(least(b[4], 800) - least(b[2], 800), 0) AS area FROM c",
    "boxes_raster": f"WITH c AS (SELECT sample_id, list_transform({_BOX}, lambda x: CAST(round_even(x::DOUBLE / 32, 0) AS INT)) AS b FROM feature_cache WHERE view_box LIKE 'crop:%'), r AS (SELECT sample_id, b, unnest(range(b[2], b[4] + 1)) AS y FROM c), p AS (SELECT DISTINCT sample_id, y, unnest(range(b[1], b[3] + 1)) AS x FROM r) SELECT sample_id, count(*) AS n_cells FROM p GROUP BY sample_id",
    "content_boxes": """WITH s AS (SELECT DISTINCT source_width AS w, source_height AS h FROM feature_cache), c AS (SELECT w, h, greatest(1, CAST(round_even(w * least(518::DOUBLE / w, 518::DOUBLE / h), 0) AS INT)) AS cw, greatest(1, CAST(round_even(h * least(518::DOUBLE / w, 518::DOUBLE / h), 0) AS INT)) AS ch FROM s)
      SELECT w AS source_width, h AS source_height, (518 - cw) // 2 AS x1, (518 - ch) // 2 AS y1, (518 - cw) // 2 + cw AS x2, (518 - ch) // 2 + ch AS y2, greatest(1, CAST(round_even(w * (256::DOUBLE / greatest(w, h)), 0) AS INT)) AS prompt_width, greatest(1, CAST(round_even(h * (256::DOUBLE / greatest(w, h)), 0) AS INT)) AS prompt_height FROM c""",
    "class_ids_json": f"{_R} SELECT record_id, array_to_string(list_sort([category, dataset, category]), '+') AS class_ids FROM records",
    "safe_filename": f"{_R} SELECT DISTINCT sample_id, regexp_replace(sample_id, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS safe FROM records WHERE sample_id IS NOT NULL",
    "method_cascade": """WITH f AS (SELECT regexp_extract(replace(file_path, '_multi', '_ms768'), 'outputs/+[^/]+/([^/]+)/', 1) AS folder FROM artifact_files), n AS (SELECT folder, regexp_replace(folder, '__.*$', '') AS n FROM f)
      SELECT CASE WHEN starts_with(n, 'sam2_only_') THEN 'sam2_only' WHEN ends_with(n, '_sam2') AND contains(n, 'ms768') THEN 'ms768_dinov2_sam2' WHEN ends_with(n, '_sam2') THEN 'single_dinov2_sam2' WHEN contains(n, 'ms768') THEN 'dinov2_ms768_heatmap' WHEN contains(n, 'dinov2') THEN 'dinov2_single_heatmap' ELSE n END AS method,
        CASE WHEN regexp_matches(folder, 'pcb\\d+') THEN regexp_extract(folder, '(pcb\\d+)', 1) ELSE folder END AS category, count(*) AS n_files FROM n GROUP BY ALL""",
    "run_id_format": "SELECT DISTINCT run_id, run_id = method || '__' || category || '__fold' || fold_id || '__k' || k || '__seed' || seed || CASE WHEN variant = 'primary' THEN '' ELSE '__' || variant END AS as_made, regexp_full_match(run_id, '[a-z0-9_]+__fold\\d+__k\\d+__seed\\d+(__[a-z0-9_]+)?') AS well_formed FROM run_specs",
    "crop_size_lists": "WITH p AS (SELECT size_bytes, list_transform(list_filter(string_split(payload, ','), lambda x: trim(x) <> ''), lambda x: trim(x)::INT) AS n FROM artifact_files WHERE payload IS NOT NULL) SELECT size_bytes, CAST(sum(len(n)) AS BIGINT) AS n_runs, CAST(sum(coalesce(list_sum(n), 0)) AS BIGINT) AS total FROM p GROUP BY size_bytes",
    "markdown_table": f"WITH {RESULTS} SELECT method, k, '| ' || method || ' | ' || k || ' | ' || printf('%.2f', avg(price)) || ' | ' || CASE WHEN method = '2-HIGH' THEN '-' ELSE printf('%.2f', avg(balance)) END || ' |' AS line FROM results GROUP BY method, k",
    "private_path_scan": "WITH p AS (SELECT unnest([image_path, mask_path, heatmap_path, debug_path]) AS p FROM scores) SELECT regexp_matches(p, '^[/~]|^(?i:file:)|^[A-Za-z]:[/\\\\]|\\\\|(^|/)\\.\\.(/|$)|[^\\x00-\\x7F]|/(root|home)/') AS private, count(*) AS n_paths FROM p WHERE p <> '' GROUP BY 1",
    "relative_paths": f"SELECT DISTINCT file_id, CASE WHEN starts_with(file_path, '{STORE}/') THEN substr(file_path, {len(STORE) + 2}) ELSE file_path END AS path FROM artifact_files",
    "stored_places": f"WITH o AS (SELECT run_id, min(output_root) AS output_root FROM run_specs GROUP BY run_id), s AS (SELECT DISTINCT score_id, run_id, heatmap_path FROM scores) SELECT score_id, {place_sql('heatmap_path', 'output_root')} AS place FROM s LEFT JOIN o USING (run_id)",
    "number_formats": "SELECT DISTINCT mask_row_id, CASE WHEN isinf(sam2_to_anomaly_area_ratio) AND sam2_to_anomaly_area_ratio > 0 THEN 'inf' ELSE 'finite' END AS ratio, round(CASE WHEN NOT isnan(mask_iou) THEN mask_iou END, 6) AS mask_iou FROM mask_scores",
}
