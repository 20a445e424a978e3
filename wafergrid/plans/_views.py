"""Canonical relations over the data folder, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wafergrid.sources.tables import table

GRID = 8


def pixels(spark: SparkSession, root: str) -> DataFrame:
    """(img, x, y, score, label, category, split, target, cand): each user's events in time order, row by row on a grid 8 wide."""
    e = table(spark, root, "events").select("user_id", "ts", "event_id", "event_type", "value")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    label = F.when(F.col("user_id") % 3 == 0, 0).otherwise(1)
    return e.withColumn("i", i).select(
        F.col("user_id").alias("img"), (F.col("i") % GRID).cast("int").alias("x"), F.floor(F.col("i") / GRID).cast("int").alias("y"), F.col("value").alias("score"),
        label.alias("label"), (F.col("user_id") % 4).cast("int").alias("category"), F.when(F.col("user_id") % 5 == 0, "val").otherwise("test").alias("split"),
        F.when((label == 1) & F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("target"),
        F.when(F.col("event_type").isin("error", "view"), 1).otherwise(0).alias("cand"),
    )


def images(spark: SparkSession, root: str) -> DataFrame:
    """(img, label, category, split, width, height), one row an image."""
    return pixels(spark, root).groupBy("img", "label", "category", "split").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """(method, category, k, seed, price, balance): means over orders and their customers."""
    o, c = table(spark, root, "orders"), table(spark, root, "customer")
    k = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    j = o.select("o_custkey", "o_totalprice", "o_orderpriority", k.alias("k"), (F.col("o_orderkey") % 5).cast("int").alias("seed")).join(c.select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("o_orderpriority").alias("method"), F.col("c_mktsegment").alias("category"), "k", "seed").agg(
        F.avg("o_totalprice").alias("price"), F.avg("c_acctbal").alias("balance"), F.count("*").alias("n_rows")
    )


def paired_cells(spark: SparkSession, root: str) -> DataFrame:
    """(category, k, seed, sample_id, label, area, thinness, baseline, candidate): a complete grid, parts x 3 shots x 3 seeds."""
    p = table(spark, root, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice").where("p_partkey is not null and p_brand is not null").distinct()
    p = p.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    base = ((F.col("p_partkey") * 7919 + F.col("k") * 104729 + F.col("seed") * 1299709) % 1000) / F.lit(1000.0)
    delta = ((F.col("p_partkey") * 31 + F.col("k") * 17 + F.col("seed") * 13) % 200 - 80) / F.lit(1000.0)
    return p.select(
        F.col("p_brand").alias("category"), "k", "seed", F.col("p_partkey").alias("sample_id"), F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1).alias("label"),
        (F.col("p_size") / F.lit(50.0)).alias("area"), (F.col("p_retailprice") / F.lit(1000.0)).alias("thinness"), base.alias("baseline"), (base + delta).alias("candidate"),
    )


def records(spark: SparkSession, root: str) -> DataFrame:
    """dataset_records without replays, with split and fold names in one spelling."""
    from wafergrid.functions.text import split_name

    r = table(spark, root, "dataset_records").drop("ingested_at").distinct()
    return r.withColumn("split", split_name(F.col("split"))).withColumn("fold_split", split_name(F.col("fold_split")))


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """(vec_id, vec, label, category, is_anom)."""
    e = table(spark, root, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("vec"), "label", (F.col("label") % 2).alias("category"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("is_anom"))


PIXELS = """pixels AS (
  SELECT user_id AS img, CAST((rn - 1) % 8 AS INT) AS x, CAST((rn - 1) // 8 AS INT) AS y, value AS score, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS label,
    CAST(user_id % 4 AS INT) AS category, CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'test' END AS split,
    CASE WHEN user_id % 3 <> 0 AND event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS target, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS cand
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events))"""
IMAGES = "images AS (SELECT img, label, category, split, max(x) + 1 AS width, max(y) + 1 AS height FROM pixels GROUP BY ALL)"
RESULTS = """results AS (
  SELECT o_orderpriority AS method, c_mktsegment AS category, [1, 2, 4][o_orderkey % 3 + 1] AS k, CAST(o_orderkey % 5 AS INT) AS seed,
    avg(o_totalprice) AS price, avg(c_acctbal) AS balance, count(*) AS n_rows
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
CELLS = """cells AS (
  SELECT p_brand AS category, k, seed, p_partkey AS sample_id, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS label, p_size / 50.0::DOUBLE AS area,
    p_retailprice / 1000.0::DOUBLE AS thinness, ((p_partkey * 7919 + k * 104729 + seed * 1299709) % 1000) / 1000.0::DOUBLE AS baseline,
    ((p_partkey * 7919 + k * 104729 + seed * 1299709) % 1000) / 1000.0::DOUBLE + ((p_partkey * 31 + k * 17 + seed * 13) % 200 - 80) / 1000.0::DOUBLE AS candidate
  FROM part, (SELECT unnest([1, 2, 4]) AS k), (SELECT unnest([0, 1, 2]) AS seed))"""
SPLIT = "CASE WHEN lower(trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) IN ('train', 'training') THEN 'train' WHEN lower(trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) IN ('val', 'valid', 'validation') THEN 'val' WHEN lower(trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) IN ('test', 'testing') THEN 'test' END"
RECORDS = f"records AS (SELECT DISTINCT * EXCLUDE (ingested_at) REPLACE ({SPLIT.format('split')} AS split, {SPLIT.format('fold_split')} AS fold_split) FROM dataset_records)"
VECTORS = "vectors AS (SELECT vec_id, embedding AS vec, label, label % 2 AS category, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS is_anom FROM embeddings)"
