"""Queries of problems 1 and 3: percentiles of the calibrations, and support samples of the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.llm.ledger import extend_saved_ledger, priority
from wafergrid.llm.overlaps import split_side, with_sample_key
from wafergrid.llm.percentiles import finite, merge, multi_select, save_summary, saved_summaries, summarize
from wafergrid.session import scratch_path
from wafergrid.sources.tables import table

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.995)
BITS = 10  # values are off by at most 2**-10 of their size
GROUP = ("scope", "group_key", "measure")


def _measured(spark: SparkSession, root: str, bits: int | None) -> DataFrame:
    """(scope, group_key, measure, day, value): each calibration once a scope and measure, values rounded to ``bits``; counts must be positive.

    Quantiles written as percent are divided by 100, and differences beyond six digits are dropped.
    """
    rows = table(spark, root, "normal_thresholds").select("calib_id", "run_id", "quantile", "threshold", "num_pixels", F.to_date("fitted_at").alias("day")).distinct()
    runs = table(spark, root, "run_specs").groupBy("run_id").agg(F.min("category").alias("category"))
    q = F.round(F.when(F.col("quantile") > 1, F.col("quantile") / 100).otherwise(F.col("quantile")), 6)
    counted = F.when(F.col("num_pixels") > 0, F.col("num_pixels"))
    rows = rows.select("run_id", "day", q.alias("q"), finite(F.col("threshold"), bits).alias("t"), finite(counted, bits).alias("px")).join(runs, "run_id", "left")
    kinds = F.expr("array(struct('run' AS scope, run_id AS group_key), struct('category_quantile' AS scope, concat(category, '/', CASE WHEN q IS NOT NULL THEN format_string('%.6f', q) END) AS group_key))")
    measures = F.expr("array(struct('threshold' AS measure, t AS value), struct('num_pixels' AS measure, px AS value))")
    out = rows.select("day", F.explode(kinds).alias("k"), measures.alias("ms")).where("k.group_key is not null").select("day", "k", F.explode("ms").alias("m"))
    return out.select("k.scope", "k.group_key", "m.measure", "day", "m.value")


def _saved(spark: SparkSession, root: str, bits: int | None) -> DataFrame:
    """The day summaries of the data folder, saved to a store of their own and read from there."""
    store = scratch_path(spark, "day_summaries")
    save_summary(summarize(_measured(spark, root, bits), GROUP, "day", "value", bits=None), store, "all")
    return saved_summaries(spark, store)


def p1_percentiles(spark: SparkSession, root: str) -> DataFrame:
    found = multi_select(merge([_saved(spark, root, BITS)], GROUP), GROUP, PERCENTILES)
    return found.withColumn("relative_bound", F.lit(2.0**-BITS))


def p1_exact_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """The same of summaries without rounding."""
    return multi_select(merge([_saved(spark, root, None)], GROUP), GROUP, PERCENTILES)


def p1_day_summary_report(spark: SparkSession, root: str) -> DataFrame:
    """How small the summaries are."""
    days = summarize(_measured(spark, root, BITS), GROUP, "day", "value", bits=None)
    return days.groupBy("scope", "measure").agg(F.count("*").alias("n_summary_rows"), F.sum("n").alias("n_values"), F.countDistinct("day").alias("n_days"))


def _support_ledger(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The ledger of each category and seed after all batches, and the runs. Runs of a category and seed share it: a run has its first k places.

    The ledger saved at the path in the setting ``spark.wafergrid.ledger`` is read and extended; without the setting a new one begins.
    """
    runs = table(spark, root, "run_specs").select("run_id", "category", "k", "seed").where("k is not null and seed is not null").distinct()
    quotas = runs.groupBy("category", "seed").agg(F.max("k").alias("quota"))
    records = table(spark, root, "dataset_records").where((split_side(F.col("split")) == "train") & (F.col("label") == 0) & F.col("category").isNotNull())
    keyed = with_sample_key(records.select("category", "sample_id", "batch_no"), "sample_id", "sample_key").where("sample_key is not null and batch_no is not null")
    seen = keyed.groupBy("category", "sample_key").agg(F.min("batch_no").alias("step"))
    seeded = seen.join(quotas.select("category", "seed"), "category").withColumn("priority", priority(F.col("seed"), F.col("sample_key")))
    path = spark.conf.get("spark.wafergrid.ledger", None) or scratch_path(spark, "support_ledger")
    return extend_saved_ledger(path, seeded, quotas, ("category", "seed"), "sample_key"), runs


def p3_support(spark: SparkSession, root: str) -> DataFrame:
    ledger, runs = _support_ledger(spark, root)
    return runs.join(ledger, ["category", "seed"]).where("place <= k").select("run_id", "sample_key", F.col("step").alias("batch_no"), "place")


def p3_ledger(spark: SparkSession, root: str) -> DataFrame:
    return _support_ledger(spark, root)[0].select("category", "seed", "sample_key", F.col("step").alias("batch_no"), "place")


QUERIES = {
    "p1_percentiles": p1_percentiles, "p1_exact_percentiles": p1_exact_percentiles, "p1_day_summary_report": p1_day_summary_report,
    "p3_support": p3_support, "p3_ledger": p3_ledger,
}

_MEASURED = r"""
measured AS (
  WITH r AS (SELECT DISTINCT calib_id, run_id, quantile, threshold, num_pixels, CAST(fitted_at AS DATE) AS day FROM normal_thresholds),
  c AS (SELECT run_id, min(category) AS category FROM run_specs GROUP BY run_id),
  j AS (SELECT r.*, c.category, round(CASE WHEN quantile > 1 THEN quantile / 100 ELSE quantile END, 6) AS q FROM r LEFT JOIN c USING (run_id)),
  s AS (
    SELECT 'run' AS scope, run_id AS group_key, day, threshold, num_pixels FROM j
    UNION ALL SELECT 'category_quantile', category || '/' || printf('%.6f', q), day, threshold, num_pixels FROM j)
  SELECT scope, group_key, 'threshold' AS measure, day, CAST(threshold AS DOUBLE) AS value FROM s
    WHERE group_key IS NOT NULL AND threshold IS NOT NULL AND NOT isnan(threshold) AND NOT isinf(threshold)
  UNION ALL SELECT scope, group_key, 'num_pixels', day, CAST(num_pixels AS DOUBLE) FROM s WHERE group_key IS NOT NULL AND num_pixels > 0)"""
_RANKED = r"""
SELECT scope, group_key, measure, p, n_values, min(value) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, group_key, measure ORDER BY value) AS rn, count(*) OVER (PARTITION BY scope, group_key, measure) AS n_values FROM v
), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.995]::DOUBLE[]) AS p)
WHERE rn >= greatest(1, ceil(p * n_values)) GROUP BY scope, group_key, measure, p, n_values"""
_ROUNDED = "CASE WHEN value = 0 THEN 0.0 ELSE round_even(value / pow(2.0, floor(log2(abs(value))) - 10), 0) * pow(2.0, floor(log2(abs(value))) - 10) END"
_LEDGER = r"""
WITH cleaned AS (
  SELECT category, batch_no, lower(trim(translate(translate(sample_id, '０１２３４５６７８９', '0123456789'), chr(160) || chr(9) || chr(10) || chr(13), '    '))) AS s
  FROM dataset_records WHERE label = 0 AND category IS NOT NULL AND batch_no IS NOT NULL
  AND lower(trim(translate(split, chr(160) || chr(9) || chr(10) || chr(13), '    '))) IN ('train', 'training')),
keyed AS (SELECT category, batch_no, regexp_replace(regexp_replace(s, '([\s_-]*(\.(png|jpe?g|bmp|gif|tiff?)|\(\d+\)|copy|dup))+\s*$', ''), '[\s/\\_-]+', '', 'g') AS sample_key FROM cleaned),
seen AS (SELECT category, sample_key, min(batch_no) AS batch_no FROM keyed WHERE sample_key <> '' GROUP BY ALL),
quotas AS (SELECT category, seed, max(k) AS quota FROM run_specs WHERE k IS NOT NULL AND seed IS NOT NULL GROUP BY ALL),
ledger AS (
  SELECT category, seed, sample_key, batch_no, row_number() OVER (PARTITION BY category, seed ORDER BY batch_no, md5(seed::VARCHAR || ':' || sample_key), sample_key) AS place, quota
  FROM seen JOIN quotas USING (category) QUALIFY place <= quota)"""

ORACLE = {
    "p1_percentiles": f"WITH {_MEASURED}, v AS (SELECT scope, group_key, measure, {_ROUNDED} AS value FROM measured), f AS ({_RANKED}) SELECT *, CAST(0.0009765625 AS DOUBLE) AS relative_bound FROM f",
    "p1_exact_percentiles": f"WITH {_MEASURED}, v AS (SELECT scope, group_key, measure, value FROM measured) {_RANKED}",
    "p1_day_summary_report": f"WITH {_MEASURED}, d AS (SELECT scope, group_key, measure, day, {_ROUNDED} AS value, count(*) AS n FROM measured GROUP BY ALL) "
    "SELECT scope, measure, count(*) AS n_summary_rows, CAST(sum(n) AS BIGINT) AS n_values, count(DISTINCT day) AS n_days FROM d GROUP BY scope, measure",
    "p3_support": f"{_LEDGER} SELECT DISTINCT run_id, sample_key, batch_no, place FROM run_specs JOIN ledger USING (category, seed) WHERE place <= k",
    "p3_ledger": f"{_LEDGER} SELECT category, seed, sample_key, batch_no, place FROM ledger",
}
