"""Queries on run results, paired cells, run matrices and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.operators import joins, lineage, stats
from wafergrid.plans._views import CELLS, RECORDS, RESULTS, paired_cells, records, run_results
from wafergrid.sources.tables import table

#: The methods, categories, shots, seeds and variants of the matrices.
METHODS = ("dinov2_single", "dinov2_multi", "patchcore", "dinov2_single_sam2", "dinov2_multi_sam2", "anomaly_consistent_sam2", "sam2_only")
CATEGORIES = ("pcb1", "pcb2", "pcb3", "pcb4")
SHOTS, SEEDS = (1, 2, 4), (4880, 4881, 4882, 4883, 4884)
ABLATIONS = {
    "crop512_o025_max": "dinov2_multi", "crop768_o000_max": "dinov2_multi", "crop768_o050_max": "dinov2_multi", "crop768_o025_mean": "dinov2_multi", "prompt_point_max": "dinov2_multi_sam2", "prompt_box": "dinov2_multi_sam2",
    "prompt_point_box_center": "dinov2_multi_sam2", "area_cap_none": "dinov2_multi_sam2", "area_cap_010": "dinov2_multi_sam2", "area_cap_050": "dinov2_multi_sam2", "fusion_union": "anomaly_consistent_sam2", "fusion_selective": "anomaly_consistent_sam2",
}
KEY = ["category", "k", "seed", "sample_id"]


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def macro_by_seed(spark: SparkSession, root: str) -> DataFrame:
    out = stats.macro_by_seed(run_results(spark, root), ["method", "k"], "category", "seed", "price")
    return out.select("method", "k", "category", "n_seeds", _r("mean", 6), _r("seed_std", 6))


def all_metrics_macro(spark: SparkSession, root: str) -> DataFrame:
    rows = run_results(spark, root).withColumn("balance", F.when(F.col("method") != "1-URGENT", F.col("balance")))
    out = stats.all_metrics_macro(rows, ["method", "k"], "category", "seed", ["price", "balance"])
    return out.select("method", "k", "metric", "category", "n_seeds", "scope", _r("mean", 6), _r("seed_std", 6))


def unpivot_metrics(spark: SparkSession, root: str) -> DataFrame:
    return stats.unpivoted(run_results(spark, root), ["method", "category", "k", "seed"], ["price", "balance"]).withColumn("value", F.round("value", 6))


def ablation_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = run_results(spark, root).where("seed = 0 and k = 4")
    return stats.ablation_rows(rows, ["method"], "category", ["price", "balance"]).select("method", "metric", "category", F.round("value", 6).alias("value"))


def mean_row(spark: SparkSession, root: str) -> DataFrame:
    per = run_results(spark, root).groupBy("category").agg(F.sum("n_rows").alias("n_rows"), F.round(F.avg("price"), 6).alias("price"), F.round(F.avg("balance"), 6).alias("balance"))
    per = per.withColumn("balance", F.when(F.col("category") == "MACHINERY", float("nan")).otherwise(F.col("balance")))
    return stats.with_mean_row(per, "category", ["n_rows"], ["price", "balance"]).select("category", "n_rows", _r("price", 6), F.round(F.nanvl("balance", F.lit(None)), 6).alias("balance"))


def method_means(spark: SparkSession, root: str) -> DataFrame:
    per = run_results(spark, root).groupBy("method", "category").agg(F.round(F.avg("price"), 6).alias("price"))
    return stats.with_group_means(per, "method", "category", ["price"]).select("method", "category", _r("price", 6))


def paired_deltas(spark: SparkSession, root: str) -> DataFrame:
    """Two methods of the same cells, joined on a key that both must have once."""
    r = run_results(spark, root)
    a, b = (r.where(F.col("method") == m).select("category", "k", "seed", "price") for m in ("1-URGENT", "5-LOW"))
    p = joins.paired(a, b, ["category", "k", "seed"], "price")
    return p.select("category", "k", "seed", F.round(F.col("candidate") - F.col("baseline"), 6).alias("delta"))


def grouping_sets_breakdown(spark: SparkSession, root: str) -> DataFrame:
    c = paired_cells(spark, root).where("label = 1")
    return stats.breakdown(c, F.col("candidate") - F.col("baseline"), ["k", "category"]).select("scope", "level", "n", _r("mean_delta"))


def excluded_normals(spark: SparkSession, root: str) -> DataFrame:
    return paired_cells(spark, root).agg(F.count_if(F.col("label") != 1).alias("n_excluded"), F.count_if(F.col("label") == 1).alias("n_kept"))


def baseline_comparisons(spark: SparkSession, root: str) -> DataFrame:
    r = run_results(spark, root)
    out = []
    for a, b in (("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("1-URGENT", "5-LOW")):
        p = joins.paired(r.where(F.col("method") == a), r.where(F.col("method") == b), ["category", "k", "seed"], "price")
        out.append(stats.breakdown(p, F.col("candidate") - F.col("baseline"), ["k", "category"]).withColumn("comparison", F.lit(f"{b} - {a}")))
    return out[0].unionByName(out[1]).unionByName(out[2]).select("comparison", "scope", "level", "n", _r("mean_delta", 6))


def bootstrap_ci(spark: SparkSession, root: str) -> DataFrame:
    return stats.bootstrap_ci(run_results(spark, root), ["method"], ["category", "k", "seed"], "price")


def paired_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    return stats.paired_bootstrap(paired_cells(spark, root).where("label = 1"), ["category", "k"], ["seed", "sample_id"], "baseline", "candidate")


def clustered_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    c = paired_cells(spark, root).where("label = 1").withColumn("comparison", F.lit("candidate - baseline"))
    return stats.clustered_bootstrap(c, ["comparison"], category="category", shot="k", seed="seed", sample="sample_id", baseline="baseline", candidate="candidate")


def decision_rule(spark: SparkSession, root: str) -> DataFrame:
    """By category, with the spread of the deltas in place of an interval."""
    c = paired_cells(spark, root).withColumn("d", F.col("candidate") - F.col("baseline"))
    g = c.groupBy("category").agg(*[F.round(F.percentile("d", F.lit(q)), 6).alias(n) for n, q in (("low", 0.39), ("high", 0.42))])
    return g.select("category", "low", "high", stats.decision(F.col("low"), F.col("high"), F.col("low") + 0.001, F.col("high") - 0.001).alias("outcome"))


def unbalanced_cells(spark: SparkSession, root: str) -> DataFrame:
    """Of a grid without the cells below 0.01."""
    return stats.unbalanced_cells(paired_cells(spark, root).where("baseline >= 0.01"), "category", "k", "seed", "sample_id")


def three_way_join(spark: SparkSession, root: str) -> DataFrame:
    """Heatmap scores, masks and thresholds of the same run and sample; of repeated rows the last one counts."""
    s = joins.last_of_each(table(spark, root, "scores").select("run_id", "sample_id", "score_id", "label"), ["run_id", "sample_id"], ["score_id"])
    m = joins.last_of_each(table(spark, root, "mask_scores").select("run_id", "sample_id", "mask_row_id", "mask_iou", "proposal_threshold"), ["run_id", "sample_id"], ["mask_row_id"])
    needs = lineage.dependency_edges(_runs(spark, root))
    j = m.join(needs, "run_id").join(s.select(F.col("run_id").alias("needs"), "sample_id", "score_id", "label"), ["needs", "sample_id"])
    return j.select("run_id", "needs", "sample_id", "mask_row_id", "score_id", "label", F.round("mask_iou", 6).alias("mask_iou"))


def fill_left_join(spark: SparkSession, root: str) -> DataFrame:
    """Paths that mask rows lack, from the last score row of the run and sample."""
    m = table(spark, root, "mask_scores").select("mask_row_id", "run_id", "sample_id", "mask_path", "heatmap_path", "category").distinct()
    s = table(spark, root, "scores").select("run_id", "sample_id", "score_id", "ingested_at", "mask_path", "heatmap_path")
    s = s.join(lineage.dependency_edges(_runs(spark, root)).withColumnRenamed("run_id", "r").withColumnRenamed("needs", "run_id"), "run_id").drop("run_id").withColumnRenamed("r", "run_id")
    return joins.fill_from(m, s, ["run_id", "sample_id"], ["score_id", "ingested_at", "mask_path", "heatmap_path"], ["mask_path", "heatmap_path"])


def threshold_fallback(spark: SparkSession, root: str) -> DataFrame:
    """The threshold of a mask row, else that of its run's last calibration."""
    c = table(spark, root, "normal_thresholds").where("threshold is not null and not isnan(threshold)").select("run_id", "calib_id", "threshold")
    c = joins.last_of_each(c.distinct(), ["run_id"], ["calib_id", "threshold"]).select("run_id", F.col("threshold").alias("run_threshold"))
    m = table(spark, root, "mask_scores").select("mask_row_id", "run_id", "proposal_threshold").distinct()
    t = F.coalesce(F.nanvl("proposal_threshold", F.lit(None)), "run_threshold")
    return m.join(c, "run_id", "left").select("mask_row_id", F.round(t, 6).alias("threshold"))


def semi_anti(spark: SparkSession, root: str) -> DataFrame:
    """Records with and without cached features, by category."""
    r = records(spark, root).select("record_id", "category", "sample_id")
    f = table(spark, root, "feature_cache").select("sample_id").distinct()
    a = r.join(f, "sample_id", "left_semi").groupBy("category").agg(F.count("*").alias("n_cached"))
    b = r.join(f, "sample_id", "left_anti").groupBy("category").agg(F.count("*").alias("n_missing"))
    return a.join(b, "category", "full").na.fill(0, ["n_cached", "n_missing"])


def cache_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Image hashes of the records' samples from the cache; for missing ones a hash is computed."""
    wanted = records(spark, root).where("sample_id is not null").select("sample_id")
    cache = table(spark, root, "feature_cache").groupBy("sample_id").agg(F.min("image_sha256").alias("image_sha256"))
    return joins.cached_or_computed(wanted, cache, "sample_id", lambda missing: missing.select("sample_id", F.sha2("sample_id", 256).alias("image_sha256")))


def _runs(spark: SparkSession, root: str) -> DataFrame:
    """One row a run, ablations too."""
    r = table(spark, root, "run_specs")
    return r.select("run_id", "method", "category", F.col("fold_id"), "k", "seed").distinct()


def run_matrix(spark: SparkSession, root: str) -> DataFrame:
    return lineage.run_matrix(spark, METHODS, CATEGORIES, SHOTS, SEEDS)


def ablation_matrix(spark: SparkSession, root: str) -> DataFrame:
    return lineage.ablation_matrix(spark, ABLATIONS, CATEGORIES, 4, 4880)


def dependency_edges(spark: SparkSession, root: str) -> DataFrame:
    return lineage.dependency_edges(_runs(spark, root))


def topo_depth(spark: SparkSession, root: str) -> DataFrame:
    r = _runs(spark, root)
    return lineage.order_by_dependency(r, lineage.dependency_edges(r))


def _listed_edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "run_specs").select("run_id", F.explode("dependencies").alias("needs")).distinct()


def closure(spark: SparkSession, root: str) -> DataFrame:
    return lineage.closure(_listed_edges(spark, root))


def missing_dependencies(spark: SparkSession, root: str) -> DataFrame:
    edges = _listed_edges(spark, root).unionByName(spark.createDataFrame([("x", "nowhere")], "run_id string, needs string"))
    return lineage.missing_dependencies(table(spark, root, "run_specs").select("run_id").distinct(), edges).select("run_id", "needs")


def violations_unique(spark: SparkSession, root: str) -> DataFrame:
    return joins.repeated_keys(table(spark, root, "scores").select("run_id", "sample_id", "score_id").distinct(), ["run_id", "sample_id"])


def violations_grid(spark: SparkSession, root: str) -> DataFrame:
    return lineage.grid_violations(_runs(spark, root).where("method <> 'sam2_only'"), ["method", "category", "k", "seed"])


def violations_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Fields in which score rows differ from the one record of their sample."""
    r = records(spark, root).where("sample_id is not null")
    once = r.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("dataset").alias("dataset"), F.min("category").alias("category"), F.min("label").alias("label"), F.min("image_path").alias("image_path")).where("n = 1")
    s = table(spark, root, "scores").select("score_id", "sample_id", "dataset", "category", "label", "image_path").distinct()
    keyed = s.select("score_id", "sample_id").join(once.drop("n"), "sample_id")
    return lineage.differing_fields(s, keyed, ["score_id"], ["dataset", "category", "label", "image_path"])


def reconcile_means(spark: SparkSession, root: str) -> DataFrame:
    """Reported ratios of masks against those worked out from their counts."""
    m = table(spark, root, "mask_scores").select("mask_row_id", "mask_iou", "intersection_pixels", "union_pixels").distinct()
    again = F.when(F.col("union_pixels") == 0, 1.0).otherwise(F.col("intersection_pixels") / F.when(F.col("union_pixels") != 0, F.col("union_pixels")))
    good = F.coalesce(lineage.close_to(F.col("mask_iou"), again), F.lit(False))
    return m.groupBy(good.alias("close")).agg(F.count("*").alias("n_rows"))


def id_set_diff(spark: SparkSession, root: str) -> DataFrame:
    """Runs that are specified or have calibrations, but not both."""
    return joins.unmatched(table(spark, root, "run_specs").select("run_id"), table(spark, root, "normal_thresholds").select("run_id"), ["run_id"])


def identity_constant(spark: SparkSession, root: str) -> DataFrame:
    """Runs whose mask rows name several models."""
    return lineage.not_constant(table(spark, root, "mask_scores"), ["run_id"], ["refiner", "sam2_model_config", "sam2_checkpoint_sha256"])


def classify_errors(spark: SparkSession, root: str) -> DataFrame:
    """Classes of failure, the texts taken as messages."""
    return table(spark, root, "documents").groupBy(lineage.failure_class(F.coalesce("text", F.lit(""))).alias("failure")).agg(F.count("*").alias("n_docs"))


def lineage_hash(spark: SparkSession, root: str) -> DataFrame:
    return _runs(spark, root).select("run_id", lineage.identity({"method": F.col("method"), "category": F.col("category"), "k": F.col("k"), "seed": F.col("seed")}).alias("identity"))


def table_checksum(spark: SparkSession, root: str) -> DataFrame:
    r = _runs(spark, root)
    return lineage.table_checksum(r, r.columns)


def support_violations(spark: SparkSession, root: str) -> DataFrame:
    """Of a support that takes each run's first samples by id, whatever their split and label."""
    from pyspark.sql import Window

    runs = _runs(spark, root).where("k > 0")
    r = records(spark, root).where("sample_id is not null").select("category", "sample_id", "record_id")
    place = F.row_number().over(Window.partitionBy("category").orderBy("record_id"))
    support = runs.join(r.withColumn("n", place).where("n <= 8"), "category").where("n <= k").select("run_id", "sample_id")
    return lineage.support_violations(support, records(spark, root), runs)


def public_projection(spark: SparkSession, root: str) -> DataFrame:
    from wafergrid.functions.text import null_for_nan, public_columns

    m = table(spark, root, "scores")
    names = public_columns([c for c in m.columns if c not in ("scored_at", "ingested_at")])
    return m.select(*[null_for_nan(F.col(c)).alias(c) if m.schema[c].dataType.simpleString() == "double" else c for c in names])


def metric_projection(spark: SparkSession, root: str) -> DataFrame:
    """Metrics by kind of method: maps have scores at every pixel, masks don't."""
    heat = F.col("method").isin("1-URGENT", "2-HIGH")
    return run_results(spark, root).select(
        "method", "category", "k", "seed", F.when(heat, "normal_q995").otherwise("binary_model_output").alias("policy"),
        F.round(F.when(heat, F.col("price")), 6).alias("image_auroc"), F.round(F.when(heat, F.col("balance") * 2).otherwise(F.col("balance")), 6).alias("mean_f1"),
    )


def config_binding(spark: SparkSession, root: str) -> DataFrame:
    """Methods whose runs of a shot share neither one output folder nor one variant."""
    r = table(spark, root, "run_specs").withColumn("top", F.regexp_extract("output_root", r"^([^/]+/[^/]+)", 1))
    g = r.groupBy("method", "k").agg(F.min("top").alias("a"), F.max("top").alias("b"), F.count_distinct("variant").alias("n_variants"))
    return g.select("method", "k", (F.col("a") == F.col("b")).alias("one_folder"), "n_variants")


QUERIES = {
    f.__name__: f
    for f in (
        macro_by_seed, all_metrics_macro, unpivot_metrics, ablation_rows, mean_row, method_means, paired_deltas, grouping_sets_breakdown, excluded_normals, baseline_comparisons, bootstrap_ci, paired_bootstrap,
        clustered_bootstrap, decision_rule, unbalanced_cells, three_way_join, fill_left_join, threshold_fallback, semi_anti, cache_lookup, run_matrix, ablation_matrix, dependency_edges, topo_depth, closure,
        missing_dependencies, violations_unique, violations_grid, violations_manifest, reconcile_means, id_set_diff, identity_constant, classify_errors, lineage_hash, table_checksum, support_violations,
        public_projection, metric_projection, config_binding,
    )
}

_W = f"WITH {RESULTS}"
_MACRO = """own AS (SELECT {by}, category, count(*) AS n_seeds, avg({v}) AS mean, coalesce(stddev_samp({v}), 0) AS seed_std FROM {t} GROUP BY ALL),
  per AS (SELECT {by}, seed, avg({v}) AS v FROM {t} GROUP BY ALL), m AS (SELECT * FROM own UNION ALL BY NAME SELECT {by}, 'macro' AS category, count(*) AS n_seeds, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS seed_std FROM per GROUP BY ALL)"""
_LONG = "long AS (SELECT method, category, k, seed, 'price' AS metric, price AS value FROM results UNION ALL SELECT method, category, k, seed, 'balance', balance FROM results)"
_BREAK = "SELECT {h}'overall' AS scope, 'all' AS level, count(*) AS n, round(avg(d), {r}) AS mean_delta FROM {t} UNION ALL SELECT {h}'k', k::VARCHAR, count(*), round(avg(d), {r}) FROM {t} GROUP BY k UNION ALL SELECT {h}'category', category, count(*), round(avg(d), {r}) FROM {t} GROUP BY category"


def _pair(a: str, b: str) -> str:
    return f"(SELECT x.category, x.k, x.seed, y.price - x.price AS d FROM results x JOIN results y USING (category, k, seed) WHERE x.method = '{a}' AND y.method = '{b}')"


_RUNS = "runs AS (SELECT DISTINCT run_id, method, category, fold_id, k, seed FROM run_specs)"
_EDGES = "edges AS (SELECT run_id, n || '__' || category || '__fold' || fold_id || '__k' || k || '__seed' || seed AS needs FROM runs JOIN (VALUES ('dinov2_single_sam2', 'dinov2_single'), ('dinov2_multi_sam2', 'dinov2_multi'), ('anomaly_consistent_sam2', 'dinov2_multi'), ('anomaly_consistent_sam2', 'dinov2_multi_sam2')) v(m, n) ON m = method)"
_CLOSE = "reach(run_id, needs, depth) AS (SELECT run_id, needs, 1 FROM e UNION ALL SELECT r.run_id, e.needs, depth + 1 FROM reach r JOIN e ON e.run_id = r.needs)"
_LISTED = "e AS (SELECT DISTINCT run_id, unnest(dependencies) AS needs FROM run_specs)"
ORACLE = {
    "macro_by_seed": f"{_W}, {_MACRO.format(by='method, k', v='price', t='results')} SELECT method, k, category, n_seeds, round(mean, 6) AS mean, round(seed_std, 6) AS seed_std FROM m",
    "all_metrics_macro": f"{_W}, {_LONG}, l AS (SELECT * FROM long WHERE NOT (metric = 'balance' AND method = '1-URGENT')), {_MACRO.format(by='method, k, metric', v='value', t='l')} SELECT method, k, metric, category, n_seeds, CASE WHEN n_seeds = 1 THEN 'descriptive_single_seed' ELSE 'support_seeds' END AS scope, round(mean, 6) AS mean, CASE WHEN n_seeds > 1 THEN round(seed_std, 6) END AS seed_std FROM m",
    "unpivot_metrics": f"{_W}, {_LONG} SELECT method, category, k, seed, metric, round(value, 6) AS value FROM long",
    "ablation_rows": f"{_W}, {_LONG}, l AS (SELECT * FROM long WHERE seed = 0 AND k = 4) SELECT method, metric, category, round(value, 6) AS value FROM l UNION ALL SELECT method, metric, 'macro', round(avg(value), 6) FROM l GROUP BY ALL",
    "mean_row": f"{_W}, p AS (SELECT category, sum(n_rows)::BIGINT AS n_rows, round(avg(price), 6) AS price, CASE WHEN category <> 'MACHINERY' THEN round(avg(balance), 6) END AS balance FROM results GROUP BY category) SELECT * FROM p UNION ALL SELECT 'mean', sum(n_rows)::BIGINT, round(avg(price), 6), round(avg(balance), 6) FROM p",
    "method_means": f"{_W}, p AS (SELECT method, category, round(avg(price), 6) AS price FROM results GROUP BY ALL) SELECT * FROM p UNION ALL SELECT method, 'mean', round(avg(price), 6) FROM p GROUP BY method",
    "paired_deltas": f"{_W} SELECT category, k, seed, round(d, 6) AS delta FROM {_pair('1-URGENT', '5-LOW')}",
    "grouping_sets_breakdown": f"WITH {CELLS}, c AS (SELECT k, category, candidate - baseline AS d FROM cells WHERE label = 1) {_BREAK.format(h='', r=6, t='c')}",
    "excluded_normals": f"WITH {CELLS} SELECT count(*) FILTER (label <> 1) AS n_excluded, count(*) FILTER (label = 1) AS n_kept FROM cells",
    "baseline_comparisons": f"{_W}, " + ", ".join(f"p{i} AS {_pair(a, b)}" for i, (a, b) in enumerate((("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("1-URGENT", "5-LOW")))) + " "
    + " UNION ALL ".join(_BREAK.format(h=f"'{b} - {a}' AS comparison, ", r=6, t=f"p{i}") for i, (a, b) in enumerate((("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("1-URGENT", "5-LOW")))),
    "decision_rule": f"WITH {CELLS}, g AS (SELECT category, round(quantile_cont(candidate - baseline, 0.39), 6) AS low, round(quantile_cont(candidate - baseline, 0.42), 6) AS high FROM cells GROUP BY category) SELECT category, low, high, CASE WHEN low > 0 AND low + 0.001 > 0 THEN 'improves' WHEN high < 0 AND high - 0.001 < 0 THEN 'inferior' ELSE 'mixed' END AS outcome FROM g",
    "unbalanced_cells": f"WITH {CELLS} SELECT category, sample_id, 'incomplete' AS violation FROM cells WHERE baseline >= 0.01 GROUP BY ALL HAVING count(*) < 9",
    "three_way_join": f"""WITH {_RUNS}, {_EDGES}, s AS (SELECT run_id, sample_id, arg_max(score_id, score_id) AS score_id, arg_max(label, score_id) AS label FROM scores GROUP BY ALL),
      m AS (SELECT run_id, sample_id, max(mask_row_id) AS mask_row_id, arg_max(mask_iou, mask_row_id) AS mask_iou FROM mask_scores GROUP BY ALL)
      SELECT m.run_id, needs, m.sample_id, mask_row_id, score_id, label, round(mask_iou, 6) AS mask_iou FROM m JOIN edges USING (run_id) JOIN s ON s.run_id = needs AND s.sample_id = m.sample_id""",
    "fill_left_join": f"""WITH {_RUNS}, {_EDGES}, s AS (SELECT e.run_id, sample_id, score_id, ingested_at, mask_path, heatmap_path FROM scores JOIN edges e ON e.needs = scores.run_id),
      l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run_id, sample_id ORDER BY score_id DESC, ingested_at DESC, mask_path DESC NULLS LAST, heatmap_path DESC NULLS LAST) = 1),
      m AS (SELECT DISTINCT mask_row_id, run_id, sample_id, mask_path, heatmap_path, category FROM mask_scores)
      SELECT mask_row_id, m.run_id, m.sample_id, CASE WHEN trim(m.mask_path) <> '' THEN m.mask_path WHEN trim(l.mask_path) <> '' THEN l.mask_path END AS mask_path, CASE WHEN trim(m.heatmap_path) <> '' THEN m.heatmap_path WHEN trim(l.heatmap_path) <> '' THEN l.heatmap_path END AS heatmap_path, category
      FROM m LEFT JOIN l ON l.run_id = m.run_id AND l.sample_id = m.sample_id""",
    "threshold_fallback": """WITH c AS (SELECT run_id, threshold FROM (SELECT DISTINCT run_id, calib_id, threshold FROM normal_thresholds WHERE NOT isnan(threshold)) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY calib_id DESC, threshold DESC) = 1),
      m AS (SELECT DISTINCT mask_row_id, run_id, proposal_threshold FROM mask_scores) SELECT mask_row_id, round(coalesce(CASE WHEN NOT isnan(proposal_threshold) THEN proposal_threshold END, threshold), 6) AS threshold FROM m LEFT JOIN c USING (run_id)""",
    "semi_anti": f"WITH {RECORDS} SELECT category, count(*) FILTER (s IN (SELECT sample_id FROM feature_cache)) AS n_cached, count(*) FILTER (NOT coalesce(s IN (SELECT sample_id FROM feature_cache), false)) AS n_missing FROM (SELECT category, sample_id AS s FROM records) GROUP BY category",
    "cache_lookup": f"WITH {RECORDS} SELECT sample_id, min(image_sha256) AS image_sha256 FROM feature_cache WHERE sample_id IN (SELECT sample_id FROM records) GROUP BY sample_id UNION ALL SELECT DISTINCT sample_id, sha256(sample_id) FROM records WHERE sample_id IS NOT NULL AND sample_id NOT IN (SELECT sample_id FROM feature_cache WHERE sample_id IS NOT NULL)",
    "run_matrix": """WITH m AS (SELECT unnest(['patchcore', 'dinov2_single', 'dinov2_multi', 'sam2_only', 'dinov2_single_sam2', 'dinov2_multi_sam2', 'anomaly_consistent_sam2']) AS method),
      s AS (SELECT * FROM (SELECT unnest([1, 2, 4]) AS k), (SELECT unnest(range(4880, 4885))::INT AS seed)),
      r AS (SELECT method, 'pcb' || c AS category, 0 AS fold_id, k, seed FROM m, (SELECT unnest(range(1, 5)) AS c), s WHERE method <> 'sam2_only' UNION ALL SELECT 'sam2_only', 'pcb' || c, 0, 0, 0 FROM (SELECT unnest(range(1, 5)) AS c))
      SELECT method || '__' || category || '__fold0__k' || k || '__seed' || seed AS run_id, * FROM r""",
    "ablation_matrix": "SELECT method || '__' || category || '__fold0__k4__seed4880__' || variant AS run_id, method, category, variant FROM (VALUES " + ", ".join(f"('{v}', '{m}')" for v, m in ABLATIONS.items()) + f") a(variant, method), (SELECT unnest({list(CATEGORIES)}) AS category)",
    "dependency_edges": f"WITH {_RUNS}, {_EDGES} SELECT * FROM edges",
    "topo_depth": f"WITH RECURSIVE {_RUNS}, {_EDGES}, e AS (SELECT DISTINCT * FROM edges), {_CLOSE} SELECT run_id, coalesce(max(depth), 0)::INT AS level FROM runs LEFT JOIN reach USING (run_id) GROUP BY run_id",
    "closure": f"WITH RECURSIVE {_LISTED}, {_CLOSE} SELECT run_id, needs, max(depth)::INT AS depth FROM reach GROUP BY ALL",
    "missing_dependencies": f"WITH {_LISTED} SELECT run_id, needs FROM (SELECT * FROM e UNION ALL SELECT 'x', 'nowhere') WHERE needs NOT IN (SELECT run_id FROM run_specs)",
    "violations_unique": "SELECT run_id, sample_id, count(DISTINCT score_id) AS n FROM scores GROUP BY ALL HAVING count(DISTINCT score_id) > 1",
    "violations_grid": f"WITH {_RUNS}, r AS (SELECT * FROM runs WHERE method <> 'sam2_only'), g AS (SELECT * FROM (SELECT DISTINCT method FROM r), (SELECT DISTINCT category FROM r), (SELECT DISTINCT k FROM r), (SELECT DISTINCT seed FROM r)) SELECT method, category, k, seed, 'missing' AS violation FROM g ANTI JOIN r USING (method, category, k, seed) UNION ALL SELECT method, category, k, seed, 'duplicate' FROM r GROUP BY ALL HAVING count(*) > 1",
    "violations_manifest": f"""WITH {RECORDS}, o AS (SELECT sample_id, min(dataset) AS dataset, min(category) AS category, min(label) AS label, min(image_path) AS image_path FROM records WHERE sample_id IS NOT NULL GROUP BY sample_id HAVING count(*) = 1),
      s AS (SELECT DISTINCT score_id, sample_id, dataset, category, label, image_path FROM scores), j AS (SELECT s.score_id, s.dataset AS d1, o.dataset AS d2, s.category AS c1, o.category AS c2, s.label::VARCHAR AS l1, o.label::VARCHAR AS l2, s.image_path AS i1, o.image_path AS i2 FROM s JOIN o USING (sample_id)),
      f AS (SELECT score_id, 'dataset' AS field, d1 AS "left", d2 AS "right" FROM j UNION ALL SELECT score_id, 'category', c1, c2 FROM j UNION ALL SELECT score_id, 'label', l1, l2 FROM j UNION ALL SELECT score_id, 'image_path', i1, i2 FROM j) SELECT * FROM f WHERE "left" IS DISTINCT FROM "right" """,
    "reconcile_means": """WITH m AS (SELECT DISTINCT mask_row_id, mask_iou, intersection_pixels AS i, union_pixels AS u FROM mask_scores), a AS (SELECT mask_iou AS x, CASE WHEN u = 0 THEN 1.0 ELSE i::DOUBLE / u END AS y FROM m)
      SELECT coalesce(abs(x - y) <= greatest(1e-10 * greatest(abs(x), abs(y)), 1e-12), false) AS close, count(*) AS n_rows FROM a GROUP BY 1""",
    "id_set_diff": "SELECT DISTINCT run_id, 'left' AS side FROM run_specs ANTI JOIN normal_thresholds USING (run_id) UNION ALL SELECT DISTINCT run_id, 'right' FROM normal_thresholds ANTI JOIN run_specs USING (run_id)",
    "identity_constant": "SELECT run_id, count(*) AS n_identities FROM (SELECT DISTINCT run_id, refiner, sam2_model_config, sam2_checkpoint_sha256 FROM mask_scores) GROUP BY run_id HAVING count(*) > 1",
    "classify_errors": """WITH l AS (SELECT lower(coalesce(text, '')) AS t FROM documents) SELECT CASE WHEN contains(t, 'missing') OR contains(t, 'no such') OR contains(t, 'directory must be real') THEN 'missing' WHEN contains(t, 'failed') OR contains(t, 'not complete') THEN 'failed'
      WHEN contains(t, 'duplicate') THEN 'duplicate' WHEN contains(t, 'dependency') OR contains(t, 'ancestor') THEN 'dependency' WHEN contains(t, 'stale') OR contains(t, 'identity') OR contains(t, 'checksum') THEN 'stale' WHEN contains(t, 'manifest row set') OR contains(t, 'metric') OR contains(t, 'evidence class') THEN 'semantic' ELSE 'artifact' END AS failure, count(*) AS n_docs FROM l GROUP BY 1""",
    "lineage_hash": f"""WITH {_RUNS} SELECT run_id, sha256('{{"category":"' || category || '","k":' || k || ',"method":"' || method || '","seed":' || seed || '}}') AS identity FROM runs""",
    "table_checksum": f"WITH {_RUNS} SELECT count(*) AS n_rows, coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}::VARCHAR, chr(30))" for c in ("run_id", "method", "category", "fold_id", "k", "seed")) + ")), 1, 12))::BIGINT), 0)::HUGEINT::VARCHAR AS checksum FROM runs",
    "support_violations": f"""WITH {RECORDS}, {_RUNS}, r AS (SELECT category, sample_id, row_number() OVER (PARTITION BY category ORDER BY record_id) AS n FROM records WHERE sample_id IS NOT NULL), s AS (SELECT run_id, runs.category, sample_id, k FROM runs JOIN r USING (category) WHERE k > 0 AND n <= k),
      c AS (SELECT run_id, k, count(sample_id) AS n, count(DISTINCT sample_id) AS d FROM runs LEFT JOIN s USING (run_id, k) WHERE k > 0 GROUP BY ALL), g AS (SELECT DISTINCT category, sample_id FROM records WHERE split = 'train' AND label = 0)
      SELECT run_id, 'count' AS violation FROM c WHERE n <> k UNION ALL SELECT run_id, 'repeated' FROM c WHERE n <> d UNION ALL SELECT DISTINCT run_id, 'not_normal_train' FROM s ANTI JOIN g USING (category, sample_id)""",
    "public_projection": "SELECT score_id, run_id, dataset, sample_id, category, label, fold_split, CASE WHEN NOT isnan(image_score) THEN image_score END AS image_score FROM scores",
    "metric_projection": f"{_W} SELECT method, category, k, seed, CASE WHEN method IN ('1-URGENT', '2-HIGH') THEN 'normal_q995' ELSE 'binary_model_output' END AS policy, round(CASE WHEN method IN ('1-URGENT', '2-HIGH') THEN price END, 6) AS image_auroc, round(CASE WHEN method IN ('1-URGENT', '2-HIGH') THEN balance * 2 ELSE balance END, 6) AS mean_f1 FROM results",
    "config_binding": "SELECT method, k, min(regexp_extract(output_root, '^([^/]+/[^/]+)', 1)) = max(regexp_extract(output_root, '^([^/]+/[^/]+)', 1)) AS one_folder, count(DISTINCT variant) AS n_variants FROM run_specs GROUP BY ALL",
}
