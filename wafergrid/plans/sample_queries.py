"""Queries on vectors, samples, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.operators import metrics, sampling, vectors as vec
from wafergrid.plans._views import CELLS, RECORDS, VECTORS, paired_cells, records, vectors

SHOTS = 32


def _bank(spark: SparkSession, root: str) -> DataFrame:
    """The support of a run: few normal vectors of each category."""
    return sampling.first_k(vectors(spark, root).where("is_anom = 0"), ["category"], "vec_id", SHOTS, 4880).drop("place")


def l2_norms(spark: SparkSession, root: str) -> DataFrame:
    v = vectors(spark, root)
    return v.select("vec_id", F.round(vec.norm(F.col("vec")), 6).alias("norm"), F.round(vec.norm(vec.unit(F.col("vec"))), 6).alias("unit_norm"))


def memory_bank(spark: SparkSession, root: str) -> DataFrame:
    b = vec.memory_bank(_bank(spark, root), "vec")
    return b.groupBy("category").agg(F.count("*").alias("n_vectors"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"))


def nn_score_sql(spark: SparkSession, root: str) -> DataFrame:
    bank = vec.memory_bank(_bank(spark, root), "vec")
    q = vectors(spark, root).withColumn("vec", vec.unit(F.col("vec")))
    return vec.nearest_distance_sql(q, bank, "vec_id", ["category"], "vec").select("vec_id", F.round("distance", 5).alias("distance"))


def nn_score_gemm(spark: SparkSession, root: str) -> DataFrame:
    out = vec.nearest_distance(vectors(spark, root), _bank(spark, root), "vec_id", "category", "vec")
    return out.select("vec_id", F.round("distance", 5).alias("distance"))


def nn_calibrated_auc(spark: SparkSession, root: str) -> DataFrame:
    """Few-shot anomaly scoring end to end: bank, scores, threshold on normal vectors outside the bank, AUC and flagged vectors."""
    v = vectors(spark, root)
    s = v.drop("vec").join(vec.nearest_distance(v, _bank(spark, root), "vec_id", "category", "vec"), "vec_id").withColumn("score", F.round("distance", 5))
    rest = s.join(_bank(spark, root).select("vec_id"), "vec_id", "left_anti")
    t = metrics.normal_threshold(rest.where("is_anom = 0"), ["category"], "score", 0.9)
    auc = metrics.roc_auc(rest, ["category"], "is_anom", "score")
    flagged = rest.join(t, "category").groupBy("category").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n_flagged"), F.count("*").alias("n_scored"))
    return auc.join(t, "category").join(flagged, "category").select("category", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("threshold", 5).alias("threshold"), "n_flagged", "n_scored")


def projected_norms(spark: SparkSession, root: str) -> DataFrame:
    p = vec.project(vectors(spark, root), "vec_id", "vec", 16, 4880)
    return p.select("vec_id", F.round(vec.norm(F.col("vec")), 4).alias("norm"))


def greedy_coreset(spark: SparkSession, root: str) -> DataFrame:
    return vec.greedy_coreset(vectors(spark, root), "category", "vec_id", "vec", ratio=0.05)


def _train_normals(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root).where("split = 'train' and label = 0").select("category", "record_id")


def few_shot_support(spark: SparkSession, root: str) -> DataFrame:
    return sampling.first_k(_train_normals(spark, root), ["category"], "record_id", 4, 4880).select("category", "record_id", "place")


def nested_support(spark: SparkSession, root: str) -> DataFrame:
    """Shots 1, 2, 4 and 8 of one seed: each holds the smaller ones."""
    s = sampling.first_k(_train_normals(spark, root), ["category"], "record_id", 8, 7)
    return s.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).where("place <= k").groupBy("category", "k").agg(F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("ids"))


def too_small_categories(spark: SparkSession, root: str) -> DataFrame:
    return sampling.too_small(_train_normals(spark, root), ["category"], 150)


def interleave(spark: SparkSession, root: str) -> DataFrame:
    q = records(spark, root).where("split = 'test'").select("category", "label", "record_id")
    return sampling.interleaved(q, ["category"], "label", "record_id")


def train_val_split(spark: SparkSession, root: str) -> DataFrame:
    out = sampling.train_validation(records(spark, root).select("category", "record_id", "split"), ["category"], "record_id", "split", 0.2, 4880)
    return out.select("record_id", "split")


def kfold(spark: SparkSession, root: str) -> DataFrame:
    return sampling.k_folds(records(spark, root).select("category", "record_id", "split"), ["category"], "record_id", "split", 5, 4880).select("record_id", "fold", "fold_split")


def kfold_counts(spark: SparkSession, root: str) -> DataFrame:
    return kfold(spark, root).groupBy("fold", "fold_split").agg(F.count("*").alias("n_rows"))


def tail_split(spark: SparkSession, root: str) -> DataFrame:
    out = sampling.tail_validation(records(spark, root).select("record_id", "split"), "record_id", "split", 100)
    return out.groupBy("split").agg(F.count("*").alias("n_rows"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))


def multilabel_folds(spark: SparkSession, root: str) -> DataFrame:
    r = records(spark, root).select("record_id", "category", "fold_id", "batch_no")
    labels = F.when(F.col("batch_no") % 3 == 0, F.array(F.col("category"), F.coalesce(F.col("fold_id"), F.lit("none")))).otherwise(F.array("category"))
    return sampling.multilabel_folds(r.withColumn("labels", labels), "record_id", "labels", 5, 4880)


def tertile_strata(spark: SparkSession, root: str) -> DataFrame:
    c = sampling.tertiles(paired_cells(spark, root), "area", F.col("label") == 1, "stratum")
    return c.groupBy("stratum").agg(F.count("*").alias("n_rows"), F.round(F.min("area"), 6).alias("least"), F.round(F.max("area"), 6).alias("most"))


def curate_topk(spark: SparkSession, root: str) -> DataFrame:
    c = paired_cells(spark, root).where("label <> 0").withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 9))
    return sampling.extremes(c, ["category"], "delta", ["sample_id", "k", "seed"], 2).select("category", "role", "place", "sample_id", "k", "seed", "delta")


QUERIES = {
    f.__name__: f
    for f in (
        l2_norms, memory_bank, nn_score_sql, nn_score_gemm, nn_calibrated_auc, projected_norms, greedy_coreset, few_shot_support, nested_support, too_small_categories, interleave,
        train_val_split, kfold, kfold_counts, tail_split, multilabel_folds, tertile_strata, curate_topk,
    )
}

_V = f"WITH {VECTORS}, u AS (SELECT *, list_transform(vec, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(vec, lambda z: z::DOUBLE * z::DOUBLE))), 1e-12)) AS uv FROM vectors), bank AS (SELECT category, vec_id, uv AS b FROM u WHERE is_anom = 0 QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('4880:' || vec_id), vec_id) <= {SHOTS})"
_D = "d AS (SELECT u.vec_id, u.category, is_anom, round(min(sqrt(greatest(0, list_sum(list_transform(list_zip(uv, b), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))), 5) AS distance FROM u JOIN bank ON u.category = bank.category GROUP BY ALL)"
_R = f"WITH {RECORDS}, normals AS (SELECT category, record_id FROM records WHERE split = 'train' AND label = 0)"
_MD5 = "md5('{0}:' || record_id)"
_KFOLD = f"{_R}, o AS (SELECT *, (row_number() OVER (PARTITION BY category, coalesce(split = 'train', false) ORDER BY {_MD5.format(4880)}, record_id) - 1) % 5 AS own FROM records), k AS (SELECT record_id, CAST(fold AS INT) AS fold, CASE WHEN coalesce(split <> 'train', true) THEN 'test' WHEN own = fold THEN 'val' ELSE 'dev' END AS fold_split FROM o, (SELECT unnest(range(5)) AS fold))"
ORACLE = {
    "l2_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings",
    "memory_bank": f"{_V} SELECT category, count(*) AS n_vectors, round(sum(list_sum(b)), 4) AS total FROM bank GROUP BY category",
    "nn_score_sql": f"{_V}, {_D} SELECT vec_id, distance FROM d",
    "nn_score_gemm": f"{_V}, {_D} SELECT vec_id, CASE WHEN distance < 1e-4 THEN 0.0 ELSE distance END AS distance FROM d",
    "nn_calibrated_auc": f"""{_V}, {_D}, rest AS (SELECT * FROM d WHERE vec_id NOT IN (SELECT vec_id FROM bank)), t AS (SELECT category, quantile_cont(distance, 0.9) AS threshold FROM rest WHERE is_anom = 0 GROUP BY category),
      r AS (SELECT category, is_anom, rank() OVER (PARTITION BY category ORDER BY distance) + (count(*) OVER (PARTITION BY category, distance) - 1) / 2.0::DOUBLE AS r FROM rest),
      a AS (SELECT category, count(*) FILTER (is_anom = 1) AS n_pos, count(*) FILTER (is_anom = 0) AS n_neg, sum(r) FILTER (is_anom = 1) AS rs FROM r GROUP BY category),
      f AS (SELECT rest.category, count(*) FILTER (distance >= threshold) AS n_flagged, count(*) AS n_scored FROM rest JOIN t USING (category) GROUP BY rest.category)
      SELECT category, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 6) AS auc, round(threshold, 5) AS threshold, n_flagged, n_scored FROM a JOIN t USING (category) JOIN f USING (category)""",
    "few_shot_support": f"{_R} SELECT category, record_id, row_number() OVER (PARTITION BY category ORDER BY {_MD5.format(4880)}, record_id) AS place FROM normals QUALIFY place <= 4",
    "nested_support": f"{_R}, o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_MD5.format(7)}, record_id) AS place FROM normals) SELECT category, k, string_agg(record_id, ',' ORDER BY record_id) AS ids FROM o, (SELECT unnest([1, 2, 4, 8]) AS k) WHERE place <= k GROUP BY ALL",
    "too_small_categories": f"{_R} SELECT category, count(*) AS n FROM normals GROUP BY category HAVING n < 150",
    "interleave": f"{_R}, t AS (SELECT category, label, record_id, row_number() OVER (PARTITION BY category, label ORDER BY record_id) AS turn FROM records WHERE split = 'test' AND label IN (0, 1)) SELECT category, label, record_id, row_number() OVER (PARTITION BY category ORDER BY turn, label DESC) AS place FROM t",
    "train_val_split": f"{_R}, o AS (SELECT *, count(*) OVER (PARTITION BY category, split) AS n, row_number() OVER (PARTITION BY category, split ORDER BY {_MD5.format(4880)}, record_id) AS place FROM records) SELECT record_id, CASE WHEN split = 'train' AND place <= least(greatest(1, round_even(n * 0.2::DOUBLE, 0)), n - 1) THEN 'val' ELSE split END AS split FROM o",
    "kfold": f"{_KFOLD} SELECT * FROM k",
    "kfold_counts": f"{_KFOLD} SELECT fold, fold_split, count(*) AS n_rows FROM k GROUP BY ALL",
    "tail_split": f"{_R}, o AS (SELECT record_id, split, CASE WHEN split = 'train' THEN row_number() OVER (PARTITION BY split ORDER BY record_id DESC) END AS last FROM records), s AS (SELECT record_id, CASE WHEN last <= 100 THEN 'val' ELSE split END AS split FROM o) SELECT split, count(*) AS n_rows, min(record_id) AS first_id, max(record_id) AS last_id FROM s GROUP BY split",
    "tertile_strata": f"WITH {CELLS}, q AS (SELECT quantile_cont(area, 1 / 3.0::DOUBLE) AS lo, quantile_cont(area, 2 / 3.0::DOUBLE) AS hi FROM cells WHERE label = 1), s AS (SELECT area, CASE WHEN label <> 1 THEN 'normal' WHEN area <= lo THEN 'small' WHEN area <= hi THEN 'medium' ELSE 'large' END AS stratum FROM cells, q) SELECT stratum, count(*) AS n_rows, round(min(area), 6) AS least, round(max(area), 6) AS most FROM s GROUP BY stratum",
    "curate_topk": f"""WITH {CELLS}, c AS (SELECT *, round(candidate - baseline, 9) AS delta FROM cells WHERE label <> 0), u AS (SELECT *, 'success' AS role, row_number() OVER (PARTITION BY category ORDER BY delta DESC, sample_id, k, seed) AS place FROM c
      UNION ALL SELECT *, 'failure', row_number() OVER (PARTITION BY category ORDER BY delta, sample_id, k, seed) FROM c) SELECT category, role, place, sample_id, k, seed, delta FROM u WHERE place <= 2""",
}
