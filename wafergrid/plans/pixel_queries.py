"""Queries over the pixel grid: calibration, confusion metrics, curves, fusion, resizing, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.operators import grids, masks, metrics
from wafergrid.plans._views import IMAGES, PIXELS, images, pixels
from wafergrid.session import written

Q = 0.995


def _round(*names: str, n: int = 6):
    return [F.round(c, n).alias(c) for c in names]


def _threshold(px: DataFrame) -> float:
    """The calibrated threshold: one number; infinite, so that nothing is predicted, where there is nothing to calibrate on."""
    found = metrics.normal_threshold(px.where("label = 0 and split = 'val'"), [], "score", Q).first()
    return found[0] if found else float("inf")


def calibrated_summary(spark: SparkSession, root: str) -> DataFrame:
    px = pixels(spark, root)
    pred = px.where("split = 'test'").withColumn("pred", masks.predicted(F.col("score"), F.lit(_threshold(px))))
    per = metrics.confusion(pred, ["img", "label", "category"], "pred", "target")
    out = metrics.summarize_confusion(per, ["category"], "label")
    return out.select("category", "n_images", "n_anomalous", *_round("micro_precision", "micro_recall", "micro_f1", "micro_iou", "mean_precision", "mean_recall", "mean_f1", "mean_iou", "mean_anomaly_precision", "mean_anomaly_recall", "mean_anomaly_f1", "mean_anomaly_iou"))


def per_image_confusion(spark: SparkSession, root: str) -> DataFrame:
    px = pixels(spark, root)
    pred = px.withColumn("pred", masks.predicted(F.col("score"), F.lit(_threshold(px))))
    return metrics.confusion(pred, ["img"], "pred", "target").select("img", "tp", "fp", "fn", *_round("precision", "recall", "f1", "iou"))


def mask_eval(spark: SparkSession, root: str) -> DataFrame:
    per = metrics.confusion(pixels(spark, root), ["img", "label", "category"], "cand", "target")
    return per.groupBy("category").agg(F.count("*").alias("n_images"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("precision", "recall", "f1", "iou")])


def normal_threshold(spark: SparkSession, root: str) -> DataFrame:
    px = pixels(spark, root).where("label = 0 and split = 'val'")
    return metrics.normal_threshold(px, ["category"], "score", Q).select("category", F.round("threshold", 6).alias("threshold"), "n_scores")


def not_calibratable_counts(spark: SparkSession, root: str) -> DataFrame:
    return metrics.not_calibratable(pixels(spark, root), "label", "split").groupBy("label", "split").agg(F.count("*").alias("n_rows"))


def percentile_per_image(spark: SparkSession, root: str) -> DataFrame:
    return pixels(spark, root).groupBy("img").agg(F.round(F.percentile("score", F.lit(0.95)), 6).alias("threshold"))


def image_scores(spark: SparkSession, root: str) -> DataFrame:
    return pixels(spark, root).groupBy("img", "label").agg(F.max("score").alias("image_score"), F.count("*").alias("n_pixels"))


def image_auc(spark: SparkSession, root: str) -> DataFrame:
    return metrics.roc_auc(image_scores(spark, root), [], "label", "image_score").select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


def roc_auc_pixels(spark: SparkSession, root: str) -> DataFrame:
    return metrics.roc_auc(pixels(spark, root), ["category"], "target", "score").select("category", "n_pos", "n_neg", F.round("auc", 9).alias("auc"))


def average_ranks(spark: SparkSession, root: str) -> DataFrame:
    return metrics.average_ranks(pixels(spark, root), ["category"], "score")


def best_f1_sweep(spark: SparkSession, root: str) -> DataFrame:
    """All distinct scores are candidates."""
    return metrics.best_f1(pixels(spark, root), ["category"], "target", "score", None).select("category", "threshold", *_round("f1", "iou", n=9), "n_thresholds")


def best_f1_linspace(spark: SparkSession, root: str) -> DataFrame:
    return metrics.best_f1(pixels(spark, root), ["category"], "target", "score", 512).select("category", *_round("threshold", "f1", "iou"), "n_thresholds")


def threshold_candidates(spark: SparkSession, root: str) -> DataFrame:
    c = metrics.threshold_candidates(pixels(spark, root), ["category"], "score", 256)
    return c.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("threshold"), 4).alias("total"), F.max("threshold").alias("highest"), F.min("threshold").alias("lowest"))


def pixel_sample(spark: SparkSession, root: str) -> DataFrame:
    """A bounded sample of pixels, in an order of hashes that other engines share."""
    px = pixels(spark, root)
    mixed = F.md5(F.concat_ws(":", F.lit("4880"), "img", "y", "x"))
    return metrics.sample_rows(px.withColumn("__h", mixed), [F.col("__h")], 1_000).select("img", "x", "y", "score", "target")


def pixel_offsets(spark: SparkSession, root: str) -> DataFrame:
    """Where each image starts in the row of all pixels."""
    from wafergrid.operators.cumulative import running_totals

    sizes = pixels(spark, root).groupBy("img").agg(F.count("*").alias("n"))
    return running_totals(sizes, [], "img", ["n"]).select("img", "n", (F.col("n_upto") - F.col("n")).alias("start"))


def proposal_vs_eval_mask(spark: SparkSession, root: str) -> DataFrame:
    """Thresholds around 0, on scores shifted so that some are not positive: the two kinds of mask differ at or below 0."""
    px = pixels(spark, root).withColumn("s", F.round(F.col("score") - 30, 6)).withColumn("t", F.explode(F.array(F.lit(-5.0), F.lit(0.0), F.lit(5.0))))
    return px.groupBy("t").agg(F.sum(masks.proposal(F.col("s"), F.col("t"))).alias("n_proposed"), F.sum(masks.predicted(F.col("s"), F.col("t"))).alias("n_predicted"))


def _two_masks(spark: SparkSession, root: str) -> DataFrame:
    return pixels(spark, root).withColumn("anomaly", masks.predicted(F.col("score"), F.lit(60.0)))


def agreement_features(spark: SparkSession, root: str) -> DataFrame:
    out = masks.agreement(_two_masks(spark, root), ["img"], "anomaly", "cand")
    return out.select("img", "first_pixels", "second_pixels", "intersection", F.col("union").alias("union_pixels"), *_round("iou", "expansion"))


def _fusion(mode: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        out = masks.fused(_two_masks(spark, root), ["img"], "anomaly", "cand", mode)
        return out.groupBy("img", "source").agg(F.sum("fused").cast("long").alias("n_pixels"))

    return query


def union_masks(spark: SparkSession, root: str) -> DataFrame:
    px = _two_masks(spark, root)
    return masks.union_of_masks(px.where("anomaly = 1").unionByName(px.where("cand = 1")), "img").groupBy("img").agg(F.count("*").alias("n_pixels"))


def mask_difference_audit(spark: SparkSession, root: str) -> DataFrame:
    px = masks.fused(_two_masks(spark, root), ["img"], "anomaly", "cand", "selective")
    out = masks.difference_counts(px, ["category"], "fused", "cand", "anomaly")
    return out.withColumn("ok", (F.col("outside_raw") == 0) & (F.col("outside_proposal") == 0) & (F.col("inexact") == 0))


def minmax_normalize(spark: SparkSession, root: str) -> DataFrame:
    return grids.minmax(pixels(spark, root), ["img"], "score").select("img", "x", "y", F.round("normalized", 6).alias("normalized"))


def bilinear_resize(spark: SparkSession, root: str) -> DataFrame:
    out = grids.resize_bilinear(pixels(spark, root), images(spark, root), "img", "score", 12, 12)
    return out.select("img", "x", "y", F.round("score", 6).alias("score"))


def nearest_resize(spark: SparkSession, root: str) -> DataFrame:
    return grids.resize_nearest(pixels(spark, root), images(spark, root), "img", "cand", 11, 13)


def block_mean(spark: SparkSession, root: str) -> DataFrame:
    out = grids.block_means(pixels(spark, root), "img", ["score", "cand"], 3)
    return out.select("img", "gy", "gx", *_round("score", "cand"))


def valid_patch_counts(spark: SparkSession, root: str) -> DataFrame:
    """Patches of 2 pixels whose centre lies in the image without its outermost pixels."""
    im = images(spark, root)
    gw, gh = F.ceil(F.col("width") / 2), F.ceil(F.col("height") / 2)
    p = im.withColumn("gy", F.explode(F.sequence(F.lit(0), gh.cast("int") - 1))).withColumn("gx", F.explode(F.sequence(F.lit(0), gw.cast("int") - 1)))
    out = grids.valid_patches(p, gw, gh, F.col("width"), F.col("height"), [F.lit(1), F.lit(1), F.col("width") - 1, F.col("height") - 1])
    return out.groupBy("img").agg(F.count("*").alias("n_patches"))


def crop_boxes(spark: SparkSession, root: str) -> DataFrame:
    return grids.crop_boxes(images(spark, root), "width", "height", 5, 0.25).select("img", "x1", "y1", "x2", "y2")


def _views(spark: SparkSession, root: str) -> DataFrame:
    """The whole image, and each crop with scores raised by its number of cells."""
    px = pixels(spark, root).select("img", "x", "y", "score")
    crops = grids.crop_boxes(images(spark, root), "width", "height", 5, 0.25).select("img", "x1", "y1", "x2", "y2")
    inside = grids.cells_in_boxes(px, crops, "img").select("img", "x", "y", (F.col("score") + (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 10.0).alias("score"))
    return px.unionByName(inside)


def _multiscale(fusion: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        return grids.fuse_views(_views(spark, root), "img", "score", fusion).select("img", "x", "y", F.round("score", 6).alias("score"))

    return query


def components(spark: SparkSession, root: str) -> DataFrame:
    return grids.components(pixels(spark, root).where("cand = 1"), "img")


def region_topk(spark: SparkSession, root: str) -> DataFrame:
    px = pixels(spark, root)
    found = grids.regions(grids.components(px.where("cand = 1"), "img"), px, "img", "score")
    return grids.top_regions(found, "img", min_area=2, most=3)


def perimeter(spark: SparkSession, root: str) -> DataFrame:
    return grids.perimeter(pixels(spark, root).where("cand = 1"), "img")


def gt_geometry(spark: SparkSession, root: str) -> DataFrame:
    """Share of the image, number of components, thinness, and mean normalized score inside the target mask."""
    import math

    px = grids.minmax(pixels(spark, root), ["img"], "score")
    target = px.where("target = 1")
    edge = grids.perimeter(target, "img")
    parts = grids.components(target, "img").groupBy("img").agg(F.count_distinct("component").alias("n_components"))
    base = px.groupBy("img").agg(F.count("*").alias("n_pixels"), F.coalesce(F.avg(F.when(F.col("target") == 1, F.col("normalized"))), F.lit(0.0)).alias("inside_mean"))
    out = base.join(edge, "img", "left").join(parts, "img", "left").na.fill(0, ["area", "perimeter", "n_components"])
    thin = F.col("perimeter") * F.col("perimeter") / F.greatest(4 * math.pi * F.col("area"), F.lit(1.0))
    return out.select("img", F.round(F.col("area") / F.col("n_pixels"), 6).alias("area_fraction"), F.col("n_components"), F.round(thin, 6).alias("thinness"), F.round("inside_mean", 6).alias("inside_mean"))


def fallback_refine(spark: SparkSession, root: str) -> DataFrame:
    px = pixels(spark, root)
    found = grids.regions(grids.components(px.where("cand = 1"), "img"), px, "img", "score")
    out = grids.refine_in_boxes(px, found, "img", "component", "score")
    return out.groupBy("img", "component").agg(F.count("*").alias("n_pixels"), F.round(F.avg("score"), 6).alias("mask_score"))


def best_candidate(spark: SparkSession, root: str) -> DataFrame:
    """Three candidate masks an image: the target, the candidate pixels, and all pixels above 60; prompted by the left half."""
    px = grids.minmax(pixels(spark, root), ["img"], "score")
    three = px.select("img", "x", "y", "normalized", F.explode(F.expr("array(named_struct('i', 0, 'm', target), named_struct('i', 1, 'm', cand), named_struct('i', 2, 'm', if(score >= 60, 1, 0)))")).alias("c"))
    on = F.col("c.m") == 1
    c = three.groupBy("img", F.col("c.i").alias("i")).agg(F.avg(F.when(on, F.col("normalized"))).alias("heat"), F.count_if(on & (F.col("x") < 4)).alias("inside"), F.count_if(on).alias("area"), F.count("*").alias("n"))
    out = grids.best_candidate(c.withColumn("s", F.lit(0.9) - 0.1 * F.col("i")), ["img"], "i", model_score="s", heat="heat", inside="inside", area="area", image_area="n", most_area=0.25)
    return out.select("img", "i", F.round("selection", 6).alias("selection"))


def grid_prompts(spark: SparkSession, root: str) -> DataFrame:
    return grids.grid_prompts(images(spark, root).select("img", "width", "height"), "width", "height", 3, 7)


def aupro(spark: SparkSession, root: str) -> DataFrame:
    px = written(pixels(spark, root).select("img", "x", "y", "score", "target"), "pixels")
    found = grids.components(px.where("target = 1"), "img").withColumnRenamed("component", "region")
    return metrics.region_overlap_score(px, found, "img", "score", "target").select("n_regions", "n_negative", F.round("aupro", 6).alias("aupro"))


QUERIES = {
    f.__name__: f
    for f in (
        calibrated_summary, per_image_confusion, mask_eval, normal_threshold, not_calibratable_counts, percentile_per_image, image_scores, image_auc, roc_auc_pixels, average_ranks, best_f1_sweep,
        best_f1_linspace, threshold_candidates, pixel_sample, pixel_offsets, proposal_vs_eval_mask, agreement_features, union_masks, mask_difference_audit, minmax_normalize, bilinear_resize, nearest_resize,
        block_mean, valid_patch_counts, crop_boxes, components, region_topk, perimeter, gt_geometry, fallback_refine, best_candidate, grid_prompts, aupro,
    )
} | {f"fuse_{m}": _fusion(m) for m in ("intersection", "union", "selective")} | {f"multiscale_{m}": _multiscale(m) for m in ("max", "mean")}

_W = f"WITH {PIXELS}"
_CONF = "CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN {d} = 0 THEN 0.0 ELSE {n}::DOUBLE / {d} END"
_P, _R, _F, _I = (_CONF.format(n=n, d=d) for n, d in (("tp", "(tp + fp)"), ("tp", "(tp + fn)"), ("(2 * tp)", "(2 * tp + fp + fn)"), ("tp", "(tp + fp + fn)")))


def _confused(rows: str, pred: str, keys: str) -> str:
    return f"""counted AS (SELECT {keys}, sum(CASE WHEN {pred} AND target = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN {pred} AND target = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
    sum(CASE WHEN NOT ({pred}) AND target = 1 THEN 1 ELSE 0 END)::BIGINT AS fn FROM {rows} GROUP BY {keys}), per AS (SELECT *, {_P} AS precision, {_R} AS recall, {_F} AS f1, {_I} AS iou FROM counted)"""


_T = "t AS (SELECT quantile_cont(score, 0.995) AS t FROM pixels WHERE label = 0 AND split = 'val')"
_MICRO = "round(CASE WHEN {d} = 0 THEN 0.0 ELSE {n}::DOUBLE / {d} END, 6)"
_AGREE = """two AS (SELECT *, CASE WHEN score >= 60 THEN 1 ELSE 0 END AS anomaly FROM pixels),
  agree AS (SELECT img, sum(anomaly)::BIGINT AS first_pixels, sum(cand)::BIGINT AS second_pixels, sum(anomaly * cand)::BIGINT AS intersection, sum(greatest(anomaly, cand))::BIGINT AS union_pixels FROM two GROUP BY img),
  features AS (SELECT *, CASE WHEN union_pixels = 0 THEN 1.0 ELSE intersection::DOUBLE / union_pixels END AS iou,
    CASE WHEN first_pixels > 0 THEN second_pixels::DOUBLE / first_pixels WHEN second_pixels = 0 THEN 1.0 ELSE 'inf'::DOUBLE END AS expansion FROM agree),
  chosen AS (SELECT two.*, iou >= 0.25 AND expansion <= 2 AS good, CASE WHEN iou >= 0.25 AND expansion <= 2 THEN anomaly * cand ELSE anomaly END AS fused FROM two JOIN features USING (img))"""


def _parts(where: str) -> str:
    return f"""m AS (SELECT img, x, y, y * 1048576 + x AS id FROM pixels WHERE {where}),
  e AS (SELECT a.img, a.id AS a, b.id AS b FROM m a JOIN m b ON a.img = b.img AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
  reach(img, id, seen) AS (SELECT img, id, id FROM m UNION SELECT e.img, reach.id, e.b FROM reach JOIN e ON e.img = reach.img AND e.a = reach.seen),
  parts AS (SELECT m.img, m.x, m.y, min(seen)::BIGINT AS component FROM m JOIN reach ON m.img = reach.img AND m.id = reach.id GROUP BY m.img, m.x, m.y)"""


_REC = f"WITH RECURSIVE {PIXELS}"
_REGIONS = """regions AS (SELECT p.img, component, min(p.x) AS x1, min(p.y) AS y1, max(p.x) + 1 AS x2, max(p.y) + 1 AS y2, count(*) AS area, max(score) AS score,
    arg_max({'x': p.x, 'y': p.y}, {'s': score, 'y': -p.y, 'x': -p.x}) AS p FROM parts p JOIN pixels q ON p.img = q.img AND p.x = q.x AND p.y = q.y GROUP BY p.img, component)"""
_EDGE = """edge AS (SELECT img, count(*) AS area, (4 * count(*) - 2 * sum(r + b))::BIGINT AS perimeter FROM (
    SELECT img, x, y, CASE WHEN lead(x) OVER (PARTITION BY img, y ORDER BY x) = x + 1 THEN 1 ELSE 0 END AS r, CASE WHEN lead(y) OVER (PARTITION BY img, x ORDER BY y) = y + 1 THEN 1 ELSE 0 END AS b FROM m) GROUP BY img)"""
_SWEEP = """best AS (SELECT category, threshold, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, tp::DOUBLE / (tp + fp + fn) AS iou, row_number() OVER (PARTITION BY category ORDER BY 2.0::DOUBLE * tp / (2 * tp + fp + fn) DESC, threshold DESC) AS rn, count(*) OVER (PARTITION BY category) AS n_thresholds
    FROM (SELECT c.category, threshold, sum(CASE WHEN score >= threshold THEN target ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN score >= threshold THEN 1 - target ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN score < threshold THEN target ELSE 0 END)::BIGINT AS fn
      FROM cand c JOIN hist h ON h.category = c.category GROUP BY c.category, threshold))"""
_HIST = "hist AS (SELECT category, score, target, count(*) AS n FROM pixels GROUP BY ALL)"
_SWEEP_N = _SWEEP.replace("THEN target ELSE", "THEN target * n ELSE").replace("THEN 1 - target ELSE", "THEN (1 - target) * n ELSE")
_LIN = "cand AS (SELECT category, max(score) + i * (min(score) - max(score)) / {m} AS threshold FROM pixels, (SELECT unnest(range({n})) AS i) GROUP BY category, i HAVING count(DISTINCT score) > {n} UNION ALL SELECT DISTINCT category, score FROM pixels WHERE category IN (SELECT category FROM pixels GROUP BY 1 HAVING count(DISTINCT score) <= {n}))"
_CROPS = "crops AS (SELECT img, x1, y1, least(x1 + 5, width) AS x2, least(y1 + 5, height) AS y2 FROM images, (SELECT unnest(range(0, 40)) AS x1), (SELECT unnest(range(0, 40)) AS y1) WHERE (CASE WHEN width <= 5 THEN x1 = 0 ELSE x1 <= width - 5 AND (x1 % 4 = 0 OR x1 = width - 5) END) AND (CASE WHEN height <= 5 THEN y1 = 0 ELSE y1 <= height - 5 AND (y1 % 4 = 0 OR y1 = height - 5) END))"
_FUSED = f"{_W}, {IMAGES}, {_CROPS}, views AS (SELECT img, x, y, score FROM pixels UNION ALL SELECT p.img, x, y, score + (x2 - x1) * (y2 - y1) / 10.0::DOUBLE FROM pixels p JOIN crops c ON p.img = c.img AND x >= x1 AND x < x2 AND y >= y1 AND y < y2) SELECT img, x, y, round({{0}}(score), 6) AS score FROM views GROUP BY ALL"
_NORM = "norm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS normalized FROM pixels WINDOW w AS (PARTITION BY img))"

ORACLE = {
    "calibrated_summary": f"""{_W}, {_T}, test AS (SELECT pixels.*, t FROM pixels, t WHERE split = 'test'), {_confused('test', 'score >= t', 'img, label, category')}
      SELECT category, count(*) AS n_images, count(*) FILTER (label = 1) AS n_anomalous, {_MICRO.format(n='sum(tp)', d='(sum(tp) + sum(fp))')} AS micro_precision, {_MICRO.format(n='sum(tp)', d='(sum(tp) + sum(fn))')} AS micro_recall,
        {_MICRO.format(n='(2 * sum(tp))', d='(2 * sum(tp) + sum(fp) + sum(fn))')} AS micro_f1, {_MICRO.format(n='sum(tp)', d='(sum(tp) + sum(fp) + sum(fn))')} AS micro_iou,
        {', '.join(f'round(avg({c}), 6) AS mean_{c}, round(avg({c}) FILTER (label = 1), 6) AS mean_anomaly_{c}' for c in ('precision', 'recall', 'f1', 'iou'))} FROM per GROUP BY category""",
    "per_image_confusion": f"{_W}, {_T}, px AS (SELECT pixels.*, t FROM pixels, t), {_confused('px', 'score >= t', 'img')} SELECT img, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou FROM per",
    "mask_eval": f"{_W}, {_confused('pixels', 'cand = 1', 'img, label, category')} SELECT category, count(*) AS n_images, {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in ('precision', 'recall', 'f1', 'iou'))} FROM per GROUP BY category",
    "normal_threshold": f"{_W} SELECT category, round(quantile_cont(score, 0.995), 6) AS threshold, count(*) AS n_scores FROM pixels WHERE label = 0 AND split = 'val' GROUP BY category",
    "not_calibratable_counts": f"{_W} SELECT label, split, count(*) AS n_rows FROM pixels WHERE NOT (label = 0 AND split = 'val') GROUP BY ALL",
    "percentile_per_image": f"{_W} SELECT img, round(quantile_cont(score, 0.95), 6) AS threshold FROM pixels GROUP BY img",
    "image_scores": f"{_W} SELECT img, label, max(score) AS image_score, count(*) AS n_pixels FROM pixels GROUP BY ALL",
    "image_auc": f"""{_W}, s AS (SELECT img, label, max(score) AS s FROM pixels GROUP BY ALL), r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM s)
      SELECT n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 9) AS auc FROM (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(r) FILTER (label = 1) AS rs FROM r)""",
    "roc_auc_pixels": f"""{_W}, r AS (SELECT category, target, rank() OVER (PARTITION BY category ORDER BY score) + (count(*) OVER (PARTITION BY category, score) - 1) / 2.0::DOUBLE AS r FROM pixels)
      SELECT category, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 9) AS auc FROM (SELECT category, count(*) FILTER (target = 1) AS n_pos, count(*) FILTER (target = 0) AS n_neg, sum(r) FILTER (target = 1) AS rs FROM r GROUP BY category)""",
    "average_ranks": f"{_W} SELECT DISTINCT category, score, count(*) OVER (PARTITION BY category, score) AS n, rank() OVER (PARTITION BY category ORDER BY score) + (count(*) OVER (PARTITION BY category, score) - 1) / 2.0::DOUBLE AS avg_rank FROM pixels",
    "best_f1_sweep": f"""{_W}, up AS (SELECT category, score AS threshold, sum(sum(target)) OVER w AS tp, sum(count(*) - sum(target)) OVER w AS fp, sum(sum(target)) OVER (PARTITION BY category) AS p FROM pixels GROUP BY category, score WINDOW w AS (PARTITION BY category ORDER BY score DESC)),
      r AS (SELECT *, 2.0::DOUBLE * tp / (tp + fp + p) AS f1, tp::DOUBLE / (fp + p) AS iou, count(*) OVER (PARTITION BY category) AS n_thresholds FROM up)
      SELECT category, threshold, round(f1, 9) AS f1, round(iou, 9) AS iou, n_thresholds FROM r QUALIFY row_number() OVER (PARTITION BY category ORDER BY f1 DESC, threshold DESC) = 1""",
    "best_f1_linspace": f"{_W}, {_HIST}, {_LIN.format(n=512, m='511.0::DOUBLE')}, {_SWEEP_N} SELECT category, round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(iou, 6) AS iou, n_thresholds FROM best WHERE rn = 1",
    "threshold_candidates": f"{_W}, {_LIN.format(n=256, m='255.0::DOUBLE')} SELECT category, count(*) AS n, round(sum(threshold), 4) AS total, max(threshold) AS highest, min(threshold) AS lowest FROM cand GROUP BY category",
    "pixel_sample": f"{_W} SELECT img, x, y, score, target FROM pixels ORDER BY md5('4880:' || img || ':' || y || ':' || x) LIMIT 1000",
    "pixel_offsets": f"{_W} SELECT img, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY img ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pixels GROUP BY img",
    "proposal_vs_eval_mask": f"{_W}, s AS (SELECT round(score - 30, 6) AS s, t FROM pixels, (SELECT unnest([-5.0, 0.0, 5.0]::DOUBLE[]) AS t)) SELECT t, count(*) FILTER (s >= t AND (t > 0 OR s > 0)) AS n_proposed, count(*) FILTER (s >= t) AS n_predicted FROM s GROUP BY t",
    "agreement_features": f"{_W}, {_AGREE} SELECT img, first_pixels, second_pixels, intersection, union_pixels, round(iou, 6) AS iou, round(expansion, 6) AS expansion FROM features",
    "fuse_intersection": f"{_W}, {_AGREE} SELECT img, 'intersection' AS source, sum(anomaly * cand)::BIGINT AS n_pixels FROM two GROUP BY img",
    "fuse_union": f"{_W}, {_AGREE} SELECT img, 'union' AS source, sum(greatest(anomaly, cand))::BIGINT AS n_pixels FROM two GROUP BY img",
    "fuse_selective": f"{_W}, {_AGREE} SELECT img, CASE WHEN good THEN 'intersection' ELSE 'first' END AS source, sum(fused)::BIGINT AS n_pixels FROM chosen GROUP BY ALL",
    "union_masks": f"{_W} SELECT img, count(*) AS n_pixels FROM (SELECT img, x, y FROM pixels WHERE score >= 60 UNION SELECT img, x, y FROM pixels WHERE cand = 1) GROUP BY img",
    "mask_difference_audit": f"""{_W}, {_AGREE} SELECT category, outside_raw, outside_proposal, inexact, outside_raw = 0 AND outside_proposal = 0 AND inexact = 0 AS ok FROM (SELECT category, count(*) FILTER (fused = 1 AND cand = 0) AS outside_raw,
      count(*) FILTER (fused = 1 AND anomaly = 0) AS outside_proposal, count(*) FILTER (fused <> cand * anomaly) AS inexact FROM chosen GROUP BY category)""",
    "minmax_normalize": f"{_W}, {_NORM} SELECT img, x, y, round(normalized, 6) AS normalized FROM norm",
    "bilinear_resize": f"""{_W}, {IMAGES}, o AS (SELECT img, width, height, x, y, greatest(0.0::DOUBLE, least((x + 0.5::DOUBLE) * width / 12 - 0.5::DOUBLE, width - 1)) AS cx, greatest(0.0::DOUBLE, least((y + 0.5::DOUBLE) * height / 12 - 0.5::DOUBLE, height - 1)) AS cy
        FROM images, (SELECT unnest(range(12)) AS x), (SELECT unnest(range(12)) AS y)),
      c AS (SELECT o.img, o.x AS ox, o.y AS oy, score, (1 - abs(cx - p.x)) * (1 - abs(cy - p.y)) AS w FROM o JOIN pixels p ON p.img = o.img AND abs(cx - p.x) < 1 AND abs(cy - p.y) < 1)
      SELECT img, CAST(ox AS INT) AS x, CAST(oy AS INT) AS y, round(sum(score * w) / sum(w), 6) AS score FROM c GROUP BY ALL""",
    "nearest_resize": f"""{_W}, {IMAGES}, o AS (SELECT img, x, y, least(floor((x + 0.5::DOUBLE) * width / 11), width - 1) AS sx, least(floor((y + 0.5::DOUBLE) * height / 13), height - 1) AS sy FROM images, (SELECT unnest(range(11)) AS x), (SELECT unnest(range(13)) AS y))
      SELECT o.img, CAST(o.x AS INT) AS x, CAST(o.y AS INT) AS y, cand FROM o JOIN pixels p ON p.img = o.img AND p.x = sx AND p.y = sy""",
    "block_mean": f"{_W} SELECT img, CAST(y // 3 AS INT) AS gy, CAST(x // 3 AS INT) AS gx, round(avg(score), 6) AS score, round(avg(cand), 6) AS cand FROM pixels GROUP BY ALL",
    "valid_patch_counts": f"""{_W}, {IMAGES}, p AS (SELECT img, width, height, (gx + 0.5::DOUBLE) * width / ceil(width / 2.0) AS cx, (gy + 0.5::DOUBLE) * height / ceil(height / 2.0) AS cy FROM images, (SELECT unnest(range(0, 40)) AS gx), (SELECT unnest(range(0, 40)) AS gy) WHERE gx < ceil(width / 2.0) AND gy < ceil(height / 2.0))
      SELECT img, count(*) AS n_patches FROM p WHERE cx >= 1 AND cx < width - 1 AND cy >= 1 AND cy < height - 1 GROUP BY img""",
    "crop_boxes": f"{_W}, {IMAGES}, {_CROPS} SELECT img, x1, y1, x2, y2 FROM crops",
    "multiscale_max": _FUSED.format("max"),
    "multiscale_mean": _FUSED.format("avg"),
    "components": f"{_REC}, {_parts('cand = 1')} SELECT * FROM parts",
    "region_topk": f"""{_REC}, {_parts('cand = 1')}, {_REGIONS} SELECT img, component, x1, y1, x2, y2, area, score, p.x AS px, p.y AS py, row_number() OVER (PARTITION BY img ORDER BY score DESC, area DESC, y1, x1, component) AS rank
      FROM regions WHERE area >= 2 QUALIFY rank <= 3""",
    "perimeter": f"{_W}, m AS (SELECT img, x, y FROM pixels WHERE cand = 1), {_EDGE} SELECT * FROM edge",
    "gt_geometry": f"""{_REC}, {_parts('target = 1')}, {_EDGE}, {_NORM}, n AS (SELECT img, count(*) AS n_pixels, coalesce(avg(normalized) FILTER (target = 1), 0.0) AS inside_mean FROM norm GROUP BY img),
      k AS (SELECT img, count(DISTINCT component) AS n_components FROM parts GROUP BY img)
      SELECT img, round(coalesce(area, 0)::DOUBLE / n_pixels, 6) AS area_fraction, coalesce(n_components, 0) AS n_components, round(coalesce(perimeter * perimeter / greatest(4 * pi() * area, 1.0), 0.0), 6) AS thinness, round(inside_mean, 6) AS inside_mean
      FROM n LEFT JOIN edge USING (img) LEFT JOIN k USING (img)""",
    "fallback_refine": f"""{_REC}, {_parts('cand = 1')}, {_REGIONS}, i AS (SELECT p.img, component, p.score, max(p.score) OVER (PARTITION BY p.img, component) AS top FROM pixels p JOIN regions r ON p.img = r.img AND x >= x1 AND x < x2 AND y >= y1 AND y < y2)
      SELECT img, component, count(*) AS n_pixels, round(avg(score), 6) AS mask_score FROM i WHERE score >= greatest(top * 0.5, 0) GROUP BY ALL""",
    "best_candidate": f"""{_W}, {_NORM}, three AS (SELECT img, x, normalized, i, [target, cand, CASE WHEN score >= 60 THEN 1 ELSE 0 END][i + 1] AS m FROM norm, (SELECT unnest(range(3)) AS i)),
      c AS (SELECT img, CAST(i AS INT) AS i, avg(normalized) FILTER (m = 1) AS heat, count(*) FILTER (m = 1 AND x < 4) AS inside, count(*) FILTER (m = 1) AS area, count(*) AS n FROM three GROUP BY ALL),
      s AS (SELECT img, i, area::DOUBLE / n <= 0.25 AS fits, CASE WHEN area > 0 THEN (0.9::DOUBLE - 0.1::DOUBLE * i) * (0.25 + heat) * (0.25 + inside::DOUBLE / area) / (0.25 + area::DOUBLE / n) ELSE 0.0 END AS selection FROM c)
      SELECT img, i, round(selection, 6) AS selection FROM s QUALIFY row_number() OVER (PARTITION BY img ORDER BY fits DESC, selection DESC, i) = 1""",
    "grid_prompts": f"""{_W}, {IMAGES}, g AS (SELECT img, width, height, r, c, CAST(round_even(c * width / 3.0::DOUBLE, 0) AS INT) AS x1, CAST(round_even((c + 1) * width / 3.0::DOUBLE, 0) AS INT) AS x2, CAST(round_even(r * height / 3.0::DOUBLE, 0) AS INT) AS y1, CAST(round_even((r + 1) * height / 3.0::DOUBLE, 0) AS INT) AS y2
        FROM images, (SELECT unnest(range(3)) AS r), (SELECT unnest(range(3)) AS c))
      SELECT img, width, height, x1, x2, y1, y2, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY img ORDER BY r, c) AS place, (x1 + x2) / 2.0::DOUBLE AS px, (y1 + y2) / 2.0::DOUBLE AS py FROM g WHERE x2 > x1 AND y2 > y1 QUALIFY place <= 7""",
    "aupro": f"""{_REC}, {_parts('target = 1')}, sz AS (SELECT img, component, count(*) AS n FROM parts GROUP BY ALL),
      j AS (SELECT q.score, q.target, 1.0::DOUBLE / n AS share FROM pixels q LEFT JOIN parts p ON p.img = q.img AND p.x = q.x AND p.y = q.y LEFT JOIN sz ON sz.img = p.img AND sz.component = p.component),
      h AS (SELECT score, sum(1 - target) AS neg, sum(coalesce(share, 0)) AS share FROM j GROUP BY score),
      cand AS (SELECT max(score) + i * (min(score) - max(score)) / 255.0::DOUBLE AS t FROM h, (SELECT unnest(range(256)) AS i) GROUP BY i),
      n AS (SELECT (SELECT count(*) FROM sz) AS n_regions, (SELECT count(*) FROM pixels WHERE target = 0) AS n_negative),
      a AS (SELECT sum(neg) / n_negative::DOUBLE AS fpr, sum(share) / n_regions AS pro FROM cand JOIN h ON score >= t, n GROUP BY t, n_regions, n_negative),
      c0 AS (SELECT fpr, max(pro) AS pro FROM a GROUP BY fpr), c AS (SELECT * FROM c0 UNION ALL SELECT 0, 0 WHERE (SELECT min(fpr) FROM c0) > 0),
      s AS (SELECT fpr, pro, lag(fpr) OVER (ORDER BY fpr) AS x0, lag(pro) OVER (ORDER BY fpr) AS y0 FROM c),
      k AS (SELECT x0, least(fpr, 0.3) AS x1, y0, CASE WHEN fpr <= 0.3 THEN pro ELSE y0 + (0.3 - x0) / (fpr - x0) * (pro - y0) END AS y1 FROM s WHERE x0 < 0.3)
      SELECT n_regions, n_negative, round((SELECT sum((x1 - x0) * (y0 + y1) / 2) FROM k) / 0.3, 6) AS aupro FROM n""",
}
