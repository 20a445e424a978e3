"""Queries of problem 2: the artifacts of the score tables, out of millions of tiny files into few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.functions.paths import with_stored_place
from wafergrid.operators.compaction import compact
from wafergrid.sources.tables import table

STORE = "/srv/pcblab/store"
TINY = 1 << 20


def referenced_places(spark: SparkSession, root: str) -> DataFrame:
    """Each stored place that a path column names, once. NULL and blank paths name none."""
    roots = table(spark, root, "run_specs").groupBy("run_id").agg(F.min("output_root").alias("output_root"))
    scores = table(spark, root, "scores").select("run_id", F.array("heatmap_path").alias("paths"))
    masks = table(spark, root, "mask_scores").select("run_id", F.array("pred_mask_path", "sam2_mask_path").alias("paths"))
    paths = scores.unionByName(masks).select("run_id", F.explode("paths").alias("path")).where("path is not null")
    placed = with_stored_place(paths.join(roots, "run_id", "left"), "path", "output_root", "place", store=STORE)
    return placed.select("place").where("place is not null").distinct()


def tiny_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """One row per referenced place of 1 to 2**20 - 1 bytes; of several listings of a place the one with the smallest file_id."""
    files = table(spark, root, "artifact_files").select("file_path", "file_id", "size_bytes", "payload", "modified_at")
    files = files.where((F.col("size_bytes") > 0) & (F.col("size_bytes") < TINY) & F.col("file_id").isNotNull())
    files = with_stored_place(files, "file_path", None, "place", store=STORE)
    files = files.join(referenced_places(spark, root), "place", "left_semi")
    first = F.min(F.struct("file_id", "size_bytes", "payload", "modified_at")).alias("f")
    return files.groupBy("place").agg(first).select("f.file_id", "place", "f.size_bytes", "f.payload", "f.modified_at")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    rows, _ = compact(tiny_artifacts(spark, root), "place", "size_bytes")
    return rows.select("file_id")


def p2_compacted_report(spark: SparkSession, root: str) -> DataFrame:
    """What the published files hold by kind of artifact."""
    rows, manifest = compact(tiny_artifacts(spark, root), "place", "size_bytes")
    kind = F.element_at(F.split("place", "/"), -2)
    return (
        rows.groupBy(kind.alias("kind"))
        .agg(F.count("*").alias("n_artifacts"), F.sum("size_bytes").alias("n_bytes"), F.countDistinct("place").alias("n_places"))
        .withColumn("n_output_files", F.lit(manifest["files"]).cast("long"))
    )


QUERIES = {"p2_found": p2_found, "p2_compacted_report": p2_compacted_report}


def _oracle() -> dict[str, str]:
    from wafergrid.plans.text_queries import place_sql

    tiny = f"""WITH o AS (SELECT run_id, min(output_root) AS output_root FROM run_specs GROUP BY run_id),
      p AS (SELECT run_id, heatmap_path AS p FROM scores UNION SELECT run_id, pred_mask_path FROM mask_scores UNION SELECT run_id, sam2_mask_path FROM mask_scores),
      r AS (SELECT DISTINCT {place_sql('p', 'output_root')} AS place FROM p LEFT JOIN o USING (run_id)),
      f AS (SELECT file_id, size_bytes, {place_sql('file_path', "''")} AS place FROM artifact_files WHERE size_bytes > 0 AND size_bytes < {TINY}),
      t AS (SELECT place, min(file_id) AS file_id, arg_min(size_bytes, file_id) AS size_bytes FROM f WHERE place IN (SELECT place FROM r) GROUP BY place)"""
    # the files published: one shard's bytes by the wanted size, as long as there is one shard
    report = f"{tiny} SELECT list_extract(string_split(place, '/'), -2) AS kind, count(*) AS n_artifacts, sum(size_bytes)::BIGINT AS n_bytes, count(DISTINCT place) AS n_places, (SELECT greatest(1, round(sum(size_bytes) / {128 << 20}))::BIGINT FROM t) AS n_output_files FROM t GROUP BY 1"
    return {"p2_found": f"{tiny} SELECT file_id FROM t", "p2_compacted_report": report}


ORACLE = _oracle()
