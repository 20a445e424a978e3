"""Queries of problem 5: records of val and test that a train record shows too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.llm.overlaps import cross_split_pairs, link_counts, overlaps
from wafergrid.operators.joins import join_groups_left
from wafergrid.sources.tables import table


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, root, "dataset_records").select("record_id", "dataset", "sample_id", "split")
    return records, table(spark, root, "feature_cache").select("sample_id", "image_sha256", "thumb")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of records: copies are expanded, as the question has it. ``p5_links`` isn't."""
    pairs = cross_split_pairs(*_tables(spark, root))
    return pairs.select(F.least("train_id", "eval_id").alias("record_a"), F.greatest("train_id", "eval_id").alias("record_b")).where("record_a < record_b").distinct()


def _with_counts(records: DataFrame, counts: DataFrame) -> DataFrame:
    return join_groups_left(records, counts, ["sample_class", "image_class"]).na.fill(0, ["n_links", "n_sample", "n_sha256", "n_thumb"])


def p5_links(spark: SparkSession, root: str) -> DataFrame:
    """Each record of a known split with its image class, named by the smallest of its records, and the number of records of the other side that it is linked with."""
    found = overlaps(*_tables(spark, root))
    names = found.records.where("image_class is not null").groupBy("image_class").agg(F.min("record_id").alias("image_of"))
    out = _with_counts(found.records.where("train"), link_counts(found, False)).unionByName(_with_counts(found.records.where("not train"), link_counts(found, True)))
    return out.join(names, "image_class", "left").select("record_id", "split", "image_of", "n_links")


def p5_overlap_report(spark: SparkSession, root: str) -> DataFrame:
    """Confirmed pairs, and records that they touch, by split and dataset of the evaluation record."""
    found = overlaps(*_tables(spark, root))
    groups = found.records.where("not train").groupBy("split", "dataset", "sample_class", "image_class").agg(F.countDistinct("record_id").alias("n"))
    total = lambda c: F.sum(F.col("n") * F.col(c))
    return _with_counts(groups, link_counts(found, True)).groupBy("split", "dataset").agg(
        F.sum("n").alias("n_records"), F.sum(F.when(F.col("n_links") > 0, F.col("n")).otherwise(0)).alias("n_overlapping"), total("n_links").alias("n_pairs"),
        *[total(f"n_{k}").alias(f"n_pairs_{k}") for k in ("sample", "sha256", "thumb")],
    )


QUERIES = {"p5_found": p5_found, "p5_links": p5_links, "p5_overlap_report": p5_overlap_report}
_BLANK = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"
#: Brute force: every train thumb against every other.
_PAIRS = rf"""WITH r AS (SELECT DISTINCT record_id, lower(trim(dataset)) AS dataset, sample_id, CASE WHEN lower(trim(split, {_BLANK})) IN ('train', 'training') THEN 'train' WHEN lower(trim(split, {_BLANK})) IN ('val', 'valid', 'validation') THEN 'val' WHEN lower(trim(split, {_BLANK})) IN ('test', 'testing') THEN 'test' END AS split FROM dataset_records),
  k AS (SELECT *, regexp_replace(regexp_replace(trim(lower(translate(translate(sample_id, '０１２３４５６７８９', '0123456789'), chr(160) || chr(9) || chr(10) || chr(13), '    '))), '([\s_-]*(\.(png|jpe?g|bmp|gif|tiff?)|\(\d+\)|copy|dup))+\s*$', ''), '[\s/\\_-]+', '', 'g') AS key FROM r WHERE split IS NOT NULL),
  f AS (SELECT DISTINCT sample_id, nullif(replace(lower(trim(image_sha256, {_BLANK})), 'sha256:', ''), '') AS sha, CASE WHEN len(thumb) = 64 AND len(list_distinct(thumb)) > 1 THEN thumb::DOUBLE[] END AS t FROM feature_cache),
  i AS (SELECT record_id, split = 'train' AS train, split, sha, list_transform(t, lambda x: x - list_avg(t)) AS z FROM k JOIN f USING (sample_id)),
  z AS (SELECT DISTINCT record_id, train, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) AS z FROM i WHERE z IS NOT NULL),
  p AS (SELECT a.record_id AS t, b.record_id AS e, 'sample' AS why FROM k a JOIN k b ON a.dataset = b.dataset AND a.key = b.key WHERE a.split = 'train' AND b.split <> 'train' AND a.key <> ''
    UNION SELECT a.record_id, b.record_id, 'sha256' FROM i a JOIN i b ON a.sha = b.sha WHERE a.train AND NOT b.train
    UNION SELECT a.record_id, b.record_id, 'thumb' FROM z a JOIN z b ON list_dot_product(a.z, b.z) >= 0.95 - 1e-12 WHERE a.train AND NOT b.train)"""
ORACLE = {
    "p5_links": f"""{_PAIRS}, n AS (SELECT record_id, count(*) AS n_links FROM (SELECT DISTINCT t AS record_id, e AS o FROM p UNION SELECT DISTINCT e, t FROM p) GROUP BY record_id),
      c AS (SELECT record_id, list_sort(list(DISTINCT CASE WHEN regexp_full_match(sha, '[0-9a-f]{{64}}') THEN sha END)) AS shas, list_sort(list(DISTINCT t)) AS thumbs FROM k JOIN f USING (sample_id) WHERE regexp_full_match(sha, '[0-9a-f]{{64}}') OR t IS NOT NULL GROUP BY record_id),
      m AS (SELECT record_id, min(record_id) OVER (PARTITION BY list_filter(shas, lambda x: x IS NOT NULL), list_filter(thumbs, lambda x: x IS NOT NULL)) AS image_of FROM c)
      SELECT record_id, split, image_of, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN m USING (record_id) LEFT JOIN n USING (record_id)""",
    "p5_found": f"{_PAIRS} SELECT DISTINCT least(t, e) AS record_a, greatest(t, e) AS record_b FROM p",
    "p5_overlap_report": f"""{_PAIRS}, o AS (SELECT e, count(DISTINCT t) AS n, count(*) FILTER (why = 'sample') AS sample, count(*) FILTER (why = 'sha256') AS sha256, count(*) FILTER (why = 'thumb') AS thumb FROM p GROUP BY e),
      g AS (SELECT split, d.dataset, count(DISTINCT record_id) AS n_records, count(n) AS n_overlapping, sum(n) AS n_pairs, sum(sample) AS a, sum(sha256) AS b, sum(thumb) AS c
        FROM (SELECT DISTINCT record_id, dataset FROM dataset_records) d JOIN (SELECT DISTINCT record_id, split FROM k WHERE split <> 'train') USING (record_id) LEFT JOIN o ON o.e = record_id GROUP BY ALL)
      SELECT split, dataset, n_records, n_overlapping, coalesce(n_pairs, 0)::BIGINT AS n_pairs, coalesce(a, 0)::BIGINT AS n_pairs_sample, coalesce(b, 0)::BIGINT AS n_pairs_sha256, coalesce(c, 0)::BIGINT AS n_pairs_thumb FROM g""",
}
