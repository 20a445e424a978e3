"""Whole pipelines over the tables of runs: few-shot scoring of patches, evaluation of heatmaps, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wafergrid.operators import grids, masks, metrics, sampling, vectors as vec
from wafergrid.plans._views import PIXELS, RECORDS, images, pixels, records
from wafergrid.plans.pixel_queries import _AGREE, ORACLE as PIXEL_ORACLE
from wafergrid.session import written
from wafergrid.sources.tables import table

#: Backbones by their name in lower case without separators, with a number and the width of their vectors.
BACKBONES = {"dinov2vits14": (0, 64), "dinov2vitb14": (1, 64), "wideresnet502": (2, 48)}
SHOTS = 64
#: Support samples a category for banks of whole samples.
SUPPORT = 5


def _patches(spark: SparkSession, root: str) -> DataFrame:
    """(patch_id, backbone, features, sample_id) of vectors that are finite and of their backbone's width."""
    name = F.regexp_replace(F.lower("backbone"), "[^a-z0-9]", "")
    cache = table(spark, root, "feature_cache").select("cache_key", "sample_id", name.alias("n")).groupBy("cache_key").agg(F.min("n").alias("n"), F.min("sample_id").alias("sample_id"))
    kinds = {i: F.element_at(F.create_map(*[F.lit(x) for k, v in BACKBONES.items() for x in (k, v[i])]), F.col("n")) for i in (0, 1)}
    p = table(spark, root, "patch_features").select("patch_id", "cache_key", "features").distinct()
    p = p.join(cache, "cache_key").withColumn("backbone", kinds[0]).withColumn("width", kinds[1])
    good = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return p.where((F.size("features") == F.col("width")) & good).select("patch_id", "backbone", "features", "sample_id")


def _labelled_samples(spark: SparkSession, root: str) -> DataFrame:
    r = records(spark, root).where("sample_id is not null")
    return r.groupBy("sample_id").agg(F.max("label").alias("label"), F.max(F.when((F.col("split") == "train") & (F.col("label") == 0), 1).otherwise(0)).alias("support"))


def _patch_scores(spark: SparkSession, root: str) -> DataFrame:
    p = written(_patches(spark, root).join(_labelled_samples(spark, root), "sample_id"), "patches")
    bank = sampling.first_k(p.where("support = 1"), ["backbone"], "patch_id", SHOTS, 4880)
    d = vec.nearest_distance(p, bank, "patch_id", "backbone", "features")
    return p.select("patch_id", "backbone", "sample_id", "label").join(d, "patch_id").join(bank.select("patch_id"), "patch_id", "left_anti")


def patch_anomaly_scores(spark: SparkSession, root: str) -> DataFrame:
    """Each patch's distance to a bank of few normal patches, its sample's score being the largest."""
    s = _patch_scores(spark, root)
    return s.groupBy("backbone", "sample_id", "label").agg(F.round(F.max("distance"), 4).alias("image_score"), F.count("*").alias("n_patches"))


def patch_anomaly_auc(spark: SparkSession, root: str) -> DataFrame:
    out = metrics.roc_auc(patch_anomaly_scores(spark, root), ["backbone"], "label", "image_score")
    return out.select("backbone", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def support_banks(patches: DataFrame, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(bank, queries) of ``patches``: backbone, category, sample_id, support and more; both with ``bank_id``.

    Of each backbone and category ``k`` support samples are drawn, the same for all backbones that have them, and all
    their patches are the bank; the patches of all other samples are the queries.
    """
    p = patches.withColumn("bank_id", F.xxhash64("backbone", "category"))
    drawn = sampling.first_k(p.where("support = 1").select("bank_id", "sample_id").distinct(), ["bank_id"], "sample_id", k, seed).select("bank_id", "sample_id")
    return p.join(drawn, ["bank_id", "sample_id"]), p.join(drawn, ["bank_id", "sample_id"], "left_anti")


def support_bank_scores(spark: SparkSession, root: str) -> DataFrame:
    """Each sample's largest patch distance to the bank of its category: all patches of few normal samples. Without such samples the score is NULL."""
    r = records(spark, root).where("sample_id is not null")
    support = (F.max(F.when(F.col("split") == "train", 1).otherwise(0)) == 1) & (F.max("label") == 0)
    samples = r.groupBy("sample_id").agg(F.min("category").alias("category"), F.max("label").alias("label"), F.when(support, 1).otherwise(0).alias("support"))
    p = written(_patches(spark, root).join(samples, "sample_id"), "patches")
    bank, queries = support_banks(p, SUPPORT, 4880)
    d = vec.nearest_distance(queries, bank, "patch_id", "bank_id", "features").groupBy("patch_id").agg(F.min("distance").alias("distance"))
    s = queries.select("patch_id", "backbone", "category", "sample_id", "label").distinct().join(d, "patch_id", "left")
    return s.groupBy("backbone", "category", "sample_id", "label").agg(F.round(F.max("distance"), 4).alias("image_score"), F.count("*").alias("n_patches"))


def support_bank_auc(spark: SparkSession, root: str) -> DataFrame:
    """ROC-AUC of each backbone and category that has a bank."""
    out = metrics.roc_auc(support_bank_scores(spark, root).where("image_score is not null"), ["backbone", "category"], "label", "image_score")
    return out.select("backbone", "category", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def score_auc_by_run(spark: SparkSession, root: str) -> DataFrame:
    """ROC-AUC of the stored image scores of each run; of retried rows the last one counts."""
    s = table(spark, root, "scores").select("run_id", "sample_id", "score_id", "label", "image_score")
    last = s.groupBy("run_id", "sample_id").agg(F.max_by(F.struct("label", "image_score"), "score_id").alias("r")).select("run_id", "r.label", "r.image_score")
    out = metrics.roc_auc(last, ["run_id"], "label", "image_score")
    return out.select("run_id", "n_pos", "n_neg", F.round("auc", 9).alias("auc"))


def heatmap_evaluation(spark: SparkSession, root: str) -> DataFrame:
    """Image AUC, pixel AUC, region overlap and best F1 of all heatmaps, in one row."""
    px = written(pixels(spark, root).select("img", "label", "x", "y", "score", "target"), "pixels")
    image = metrics.roc_auc(px.groupBy("img", "label").agg(F.max("score").alias("score")), [], "label", "score")
    pixel = metrics.roc_auc(px, [], "target", "score")
    best = metrics.best_f1(px, [], "target", "score")
    found = grids.components(px.where("target = 1"), "img").withColumnRenamed("component", "region")
    overlap = metrics.region_overlap_score(px, found, "img", "score", "target")
    parts = ((image, {"image_auc": "auc"}), (pixel, {"pixel_auc": "auc"}), (best, {"best_f1": "f1", "best_iou": "iou"}), (overlap, {"aupro": "aupro"}))
    long = None  # one row a metric, turned to one row
    for df, names in parts:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in names.items()])).alias("m")).select("m.*")
        long = rows if long is None else long.unionByName(rows)
    order = ("image_auc", "pixel_auc", "best_f1", "best_iou", "aupro")
    return long.agg(*[F.round(F.max(F.when(F.col("name") == n, F.col("value"))), 6).alias(n) for n in order])


def audit_invariants(spark: SparkSession, root: str) -> DataFrame:
    """Masks of two methods pixel by pixel: pixels that only one has, and where the fused mask isn't what its rule gives."""
    px = pixels(spark, root).withColumn("anomaly", masks.predicted(F.col("score"), F.lit(60.0)))
    fused = masks.fused(px, ["img"], "anomaly", "cand", "selective").select("img", "x", "y", "fused")
    guided = px.where("not (x = 7 and y = 0)").select("img", "x", "y", "anomaly", "cand", F.lit(1).alias("there"))
    j = guided.join(fused, ["img", "x", "y"], "full")
    a, c, f = F.col("anomaly") == 1, F.col("cand") == 1, F.col("fused") == 1
    out = j.agg(
        F.count_if(F.col("fused").isNull()).alias("only_guided"), F.count_if(F.col("there").isNull()).alias("only_fused"), F.count_if(f & ~a).alias("outside_proposal"),
        F.count_if(f & ~c).alias("outside_raw"), F.count_if(f != (a & c)).alias("inexact"), F.count("*").alias("n_pixels"),
    )
    return out.withColumn("ok", (F.col("only_guided") + F.col("only_fused") + F.col("outside_proposal") + F.col("outside_raw") + F.col("inexact")) == 0)


def override_merge(spark: SparkSession, root: str) -> DataFrame:
    """Effective parameters of runs: usual values with the run's own laid over them."""
    usual = {"fusion": "max", "crop_size": "768", "prompt": "point_box"}
    r = table(spark, root, "run_specs").select("run_id", "overrides_json").distinct()
    base = F.create_map(*[F.lit(x) for kv in usual.items() for x in kv])
    own = F.coalesce(F.from_json("overrides_json", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    keep = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return r.select("run_id", F.explode(F.map_concat(keep, own)).alias("name", "value"))


def artifact_hashes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "artifact_files").where("payload is not null").select("file_id", F.sha2("payload", 256).alias("sha256"), F.length("payload").alias("n_chars")).distinct()


def scaled_grid_prompts(spark: SparkSession, root: str) -> DataFrame:
    return grids.grid_prompts(images(spark, root).select("img", "width", "height"), "width", "height", 2, 4, scale=0.5).select("img", "place", "x1", "y1", "x2", "y2", "area")


def patch_projection(spark: SparkSession, root: str) -> DataFrame:
    """Block means of an image brought back to the image's size by way of the prepared content."""
    px = pixels(spark, root)
    p = grids.block_means(px, "img", ["score"], 2).select("img", F.col("gx").alias("x"), F.col("gy").alias("y"), "score")
    sizes = p.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    out = grids.project_to_source(p, sizes, "img", "score", (6, 6), (8, 8))
    return out.groupBy("img").agg(F.round(F.avg("score"), 5).alias("mean"), F.round(F.max("score"), 5).alias("highest"), F.count("*").alias("n_pixels"))


def event_windows(spark: SparkSession, root: str) -> DataFrame:
    """The batch form of the windowed summary of a score stream."""
    e = table(spark, root, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("highest"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "mean", "highest")


QUERIES = {
    f.__name__: f
    for f in (
        patch_anomaly_scores, patch_anomaly_auc, support_bank_scores, support_bank_auc, score_auc_by_run, heatmap_evaluation, audit_invariants, override_merge, artifact_hashes, scaled_grid_prompts, patch_projection, event_windows,
    )
}

_W = f"WITH {PIXELS}"
_PATCH = f"""WITH {RECORDS}, l AS (SELECT sample_id, max(label) AS label, max(CASE WHEN split = 'train' AND label = 0 THEN 1 ELSE 0 END) AS support FROM records WHERE sample_id IS NOT NULL GROUP BY sample_id),
  c AS (SELECT cache_key, min(regexp_replace(lower(backbone), '[^a-z0-9]', '', 'g')) AS n, min(sample_id) AS sample_id FROM feature_cache GROUP BY cache_key),
  p AS (SELECT DISTINCT patch_id, CASE n WHEN 'dinov2vits14' THEN 0 WHEN 'dinov2vitb14' THEN 1 WHEN 'wideresnet502' THEN 2 END AS backbone, features, c.sample_id, label, support
    FROM patch_features JOIN c USING (cache_key) JOIN l ON l.sample_id = c.sample_id WHERE len(features) = CASE n WHEN 'wideresnet502' THEN 48 ELSE 64 END AND len(list_filter(features, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  u AS (SELECT *, list_transform(features, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(features, lambda z: z::DOUBLE * z::DOUBLE))), 1e-12)) AS v FROM p),
  bank AS (SELECT patch_id, backbone, v AS b FROM u WHERE support = 1 QUALIFY row_number() OVER (PARTITION BY backbone ORDER BY md5('4880:' || patch_id), patch_id) <= {SHOTS}),
  d AS (SELECT u.patch_id, u.backbone, sample_id, label, min(sqrt(greatest(0, list_sum(list_transform(list_zip(v, b), lambda q: (q[1] - q[2]) * (q[1] - q[2])))))) AS distance FROM u JOIN bank ON u.backbone = bank.backbone WHERE u.patch_id NOT IN (SELECT patch_id FROM bank) GROUP BY ALL),
  s AS (SELECT backbone, sample_id, label, round(max(distance), 4) AS image_score, count(*) AS n_patches FROM d GROUP BY ALL)"""
_SUPPORT = f"""WITH {RECORDS}, l AS (SELECT sample_id, min(category) AS category, max(label) AS label, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) = 1 AND max(label) = 0 AS support FROM records WHERE sample_id IS NOT NULL GROUP BY sample_id),
  c AS (SELECT cache_key, min(regexp_replace(lower(backbone), '[^a-z0-9]', '', 'g')) AS n, min(sample_id) AS sample_id FROM feature_cache GROUP BY cache_key),
  p AS (SELECT DISTINCT patch_id, CASE n WHEN 'dinov2vits14' THEN 0 WHEN 'dinov2vitb14' THEN 1 WHEN 'wideresnet502' THEN 2 END AS backbone, features, c.sample_id, category, label, support
    FROM patch_features JOIN c USING (cache_key) JOIN l ON l.sample_id = c.sample_id WHERE len(features) = CASE n WHEN 'dinov2vits14' THEN 64 WHEN 'dinov2vitb14' THEN 64 WHEN 'wideresnet502' THEN 48 END AND len(list_filter(features, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  u AS (SELECT *, list_transform(features, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(features, lambda z: z::DOUBLE * z::DOUBLE))), 1e-12)) AS v FROM p),
  drawn AS (SELECT backbone, category, sample_id FROM (SELECT DISTINCT backbone, category, sample_id FROM u WHERE support) QUALIFY row_number() OVER (PARTITION BY backbone, category ORDER BY md5('4880:' || sample_id), sample_id) <= {SUPPORT}),
  q AS (SELECT u.* FROM u LEFT JOIN drawn d ON u.backbone = d.backbone AND u.category IS NOT DISTINCT FROM d.category AND u.sample_id = d.sample_id WHERE d.sample_id IS NULL),
  bank AS (SELECT u.backbone, u.category, v AS b FROM u JOIN drawn d ON u.backbone = d.backbone AND u.category IS NOT DISTINCT FROM d.category AND u.sample_id = d.sample_id),
  d AS (SELECT q.patch_id, q.backbone, q.category, q.sample_id, q.label, min(CASE WHEN b IS NOT NULL THEN sqrt(greatest(0, list_sum(list_transform(list_zip(v, b), lambda w: (w[1] - w[2]) * (w[1] - w[2]))))) END) AS distance FROM q LEFT JOIN bank ON q.backbone = bank.backbone AND q.category IS NOT DISTINCT FROM bank.category GROUP BY ALL),
  s AS (SELECT backbone, category, sample_id, label, round(max(distance), 4) AS image_score, count(*) AS n_patches FROM d GROUP BY ALL), t AS (SELECT * FROM s WHERE image_score IS NOT NULL)"""
_AUC = "SELECT {k}, n_pos, n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg) END, {r}) AS auc FROM (SELECT {k}, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(rk) FILTER (label = 1) AS rs FROM (SELECT {k}, label, rank() OVER (PARTITION BY {k} ORDER BY image_score) + (count(*) OVER (PARTITION BY {k}, image_score) - 1) / 2.0::DOUBLE AS rk FROM {t} WHERE label IN (0, 1) AND NOT isnan(image_score)) GROUP BY {k})"
#: All pixels as one category.
_ONE = {k: PIXEL_ORACLE[k].replace("CAST(user_id % 4 AS INT) AS category", "0 AS category") for k in ("roc_auc_pixels", "best_f1_linspace")}
ORACLE = {
    "patch_anomaly_scores": f"{_PATCH} SELECT * FROM s",
    "patch_anomaly_auc": f"{_PATCH} {_AUC.format(k='backbone', r=6, t='s')}",
    "support_bank_scores": f"{_SUPPORT} SELECT * FROM s",
    "support_bank_auc": f"{_SUPPORT} {_AUC.format(k='backbone, category', r=6, t='t')}",
    "score_auc_by_run": f"WITH s AS (SELECT run_id, label, image_score FROM (SELECT DISTINCT run_id, sample_id, score_id, label, image_score FROM scores) QUALIFY row_number() OVER (PARTITION BY run_id, sample_id ORDER BY score_id DESC) = 1) {_AUC.format(k='run_id', r=9, t='s')}",
    "audit_invariants": f"""{_W}, {_AGREE}, j AS (SELECT *, x = 7 AND y = 0 AS gone FROM chosen) SELECT 0::BIGINT AS only_guided, count(*) FILTER (gone) AS only_fused, count(*) FILTER (NOT gone AND fused = 1 AND anomaly = 0) AS outside_proposal,
      count(*) FILTER (NOT gone AND fused = 1 AND cand = 0) AS outside_raw, count(*) FILTER (NOT gone AND fused <> anomaly * cand) AS inexact, count(*) AS n_pixels, count(*) FILTER (gone) = 0 AND count(*) FILTER (fused <> anomaly * cand) = 0 AS ok FROM j""",
    "heatmap_evaluation": f"""SELECT round(a.auc, 6) AS image_auc, round(b.auc, 6) AS pixel_auc, c.f1 AS best_f1, c.iou AS best_iou, d.aupro
      FROM ({PIXEL_ORACLE['image_auc']}) a, ({_ONE['roc_auc_pixels']}) b, ({_ONE['best_f1_linspace']}) c, ({PIXEL_ORACLE['aupro']}) d""",
    "override_merge": """WITH r AS (SELECT DISTINCT run_id, overrides_json FROM run_specs), k AS (SELECT run_id, overrides_json AS j, unnest(list_distinct(list_concat(['fusion', 'crop_size', 'prompt'], coalesce(json_keys(overrides_json), [])))) AS name FROM r)
      SELECT run_id, name, coalesce(j ->> ('$."' || name || '"'), MAP {'fusion': 'max', 'crop_size': '768', 'prompt': 'point_box'}[name]) AS value FROM k""",
    "artifact_hashes": "SELECT DISTINCT file_id, sha256(payload) AS sha256, CAST(length(payload) AS INT) AS n_chars FROM artifact_files WHERE payload IS NOT NULL",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS highest FROM events GROUP BY 1",
    "scaled_grid_prompts": f"""{_W}, i AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY img), g AS (SELECT img, w, h, r * 2 + c + 1 AS place, round_even(c * w / 2.0::DOUBLE, 0) AS a1, round_even((c + 1) * w / 2.0::DOUBLE, 0) AS a2, round_even(r * h / 2.0::DOUBLE, 0) AS b1, round_even((r + 1) * h / 2.0::DOUBLE, 0) AS b2 FROM i, (SELECT unnest(range(2)) AS r), (SELECT unnest(range(2)) AS c)),
      s AS (SELECT img, w, h, place, greatest(1, round_even((a2 - a1) * 0.5, 0)) AS sw, greatest(1, round_even((b2 - b1) * 0.5, 0)) AS sh, (a1 + a2) / 2.0::DOUBLE AS cx, (b1 + b2) / 2.0::DOUBLE AS cy FROM g),
      t AS (SELECT *, least(greatest(0, round_even(cx - sw / 2, 0)) + sw, w) AS x2, least(greatest(0, round_even(cy - sh / 2, 0)) + sh, h) AS y2 FROM s)
      SELECT img, place::INT AS place, (x2 - sw)::INT AS x1, (y2 - sh)::INT AS y1, x2::INT AS x2, y2::INT AS y2, (sw * sh)::INT AS area FROM t""",
}
