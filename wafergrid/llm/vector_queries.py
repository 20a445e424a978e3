"""Queries of problem 4: the most similar patch vectors of each vector, within its backbone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.llm.neighbors import ListParams, nearest, usable
from wafergrid.session import written
from wafergrid.sources.tables import table

K = 5
PARAMS = ListParams()

#: The width of a backbone's vectors, by its name in lower case without separators.
WIDTHS = {"dinov2vits14": 64, "dinov2vitb14": 64, "wideresnet502": 48}


def patch_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(space, id, vec): the usable vectors with their backbone, however it is written. Replays stay, as equal rows."""
    name = F.regexp_replace(F.lower("backbone"), "[^a-z0-9]", "")
    cache = table(spark, root, "feature_cache").select("cache_key", name.alias("space")).where(F.col("space").isin(*WIDTHS)).groupBy("cache_key").agg(F.min("space").alias("space"))
    width = F.element_at(F.create_map(*[F.lit(y) for kv in WIDTHS.items() for y in kv]), F.col("space"))
    patches = table(spark, root, "patch_features").where("patch_id is not null and features is not null").select("patch_id", "cache_key", "features")
    return patches.join(cache, "cache_key").where(usable(F.col("features"), width)).select("space", F.col("patch_id").alias("id"), F.col("features").alias("vec"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    vectors = written(patch_vectors(spark, root), "vectors")
    probes = table(spark, root, "patch_probes").select(F.col("patch_id").alias("id")).distinct()
    hits = nearest(vectors, vectors.join(probes, "id", "left_semi"), K, PARAMS)
    return hits.select(F.least("query", "neighbor").alias("patch_a"), F.greatest("query", "neighbor").alias("patch_b")).distinct()


def p4_neighbors(spark: SparkSession, root: str) -> DataFrame:
    """The stated query set, every id divisible by 100, against all vectors."""
    vectors = written(patch_vectors(spark, root), "vectors")
    hits = nearest(vectors, vectors.where("id % 100 = 0"), K, PARAMS)
    return hits.select(F.col("query").alias("patch_id"), F.col("neighbor").alias("neighbor_id"), "rank", F.round("cosine", 6).alias("cosine"))


QUERIES = {"p4_found": p4_found, "p4_neighbors": p4_neighbors}
_NEAREST = """WITH c AS (SELECT cache_key, min(CASE regexp_replace(lower(backbone), '[^a-z0-9]', '', 'g') WHEN 'dinov2vits14' THEN 's' WHEN 'dinov2vitb14' THEN 'b' WHEN 'wideresnet502' THEN 'w' END) AS space FROM feature_cache GROUP BY cache_key),
  v AS (SELECT DISTINCT patch_id, space, features::DOUBLE[] AS f FROM patch_features JOIN c USING (cache_key) WHERE len(features) = CASE space WHEN 'w' THEN 48 ELSE 64 END
    AND len(list_filter(features, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(features, lambda x: x <> 0)) > 0),
  r AS (SELECT q.patch_id AS a, o.patch_id AS b, list_cosine_similarity(q.f, o.f) AS cosine, row_number() OVER (PARTITION BY q.patch_id ORDER BY round(list_cosine_similarity(q.f, o.f), 12) DESC, o.patch_id) AS rank
    FROM v q JOIN v o ON q.space = o.space AND q.patch_id <> o.patch_id WHERE {0} QUALIFY rank <= 5)"""
#: Brute force: every vector against the query set.
ORACLE = {
    "p4_found": _NEAREST.format("q.patch_id IN (SELECT patch_id FROM patch_probes)") + " SELECT DISTINCT least(a, b) AS patch_a, greatest(a, b) AS patch_b FROM r",
    "p4_neighbors": _NEAREST.format("q.patch_id % 100 = 0") + " SELECT a AS patch_id, b AS neighbor_id, rank, round(cosine, 6) AS cosine FROM r",
}
