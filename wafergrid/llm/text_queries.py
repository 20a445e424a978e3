"""Queries of problems 6 and 7: token ids of the corpus, and documents in containers of a fixed number of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.llm.bpe import with_ids, with_token_count
from wafergrid.llm.packing import pack
from wafergrid.sources.tables import table

CAPACITY = 2_048


def spread(df: DataFrame) -> DataFrame:
    """``df`` as its files are split; dealt anew only where these are fewer than the tasks that run at once, which are few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return with_ids(_documents(spark, root), keep=["doc_id"])


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    sizes = with_token_count(_documents(spark, root), keep=["doc_id"])
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents that the packing had to split."""
    return p7_packed(spark, root).where("n_pieces > 1").select("doc_id").distinct()


def p7_container_report(spark: SparkSession, root: str) -> DataFrame:
    """How well the containers are filled; ``n_least`` is the number that no packing can do with less than."""
    bins = p7_packed(spark, root).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_pieces"))
    return bins.agg(
        F.count("*").alias("n_containers"), F.ceil(F.sum("used") / CAPACITY).alias("n_least"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.sum("n_pieces").alias("n_pieces"),
        F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("filled"),
    )


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_packed": p7_packed, "p7_container_report": p7_container_report}
ORACLE: dict[str, str] = {}
