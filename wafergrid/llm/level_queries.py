"""Queries of problem 8: reading levels of the English prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.llm.reading import LevelParams, calibrated, coverage, measured, ranked_words, with_level
from wafergrid.llm.text_queries import spread
from wafergrid.session import written
from wafergrid.sources.tables import table

PARAMS = LevelParams()


def labelled_english(lang: Column) -> Column:
    """Whether a label names English, however it is written ('en', 'EN', 'eng', ...); NULL where there is none or it is undetermined."""
    name = F.lower(F.trim(lang))
    return F.when((name != "") & (name != "und"), F.startswith(name, F.lit("en")))


KEY = ["passage", "id"]


def _measures(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(passage, id, x0, ...) of each passage and each English prose text, and (passage, id, reading_level) of the labels; ``passage`` tells which of the two an id is of."""
    docs = spread(table(spark, root, "documents").select("doc_id", "text", labelled_english(F.col("lang")).alias("en")).where("doc_id is not null"))
    docs = written(measured(docs, "doc_id", "text", PARAMS, "en"), "words")
    given = table(spark, root, "level_passages").where("reading_level is not null").distinct()
    passages = measured(given, "passage_id", "passage", PARAMS).select(F.lit(True).alias("passage"), F.col("passage_id").alias("id"), "words", "n_sentences")
    prose = docs.where("prose").select(F.lit(False).alias("passage"), F.col("doc_id").alias("id"), "words", "n_sentences")
    ranks = written(ranked_words(docs, "en"), "ranks")
    measures = written(coverage(prose.unionByName(passages), ranks, KEY, PARAMS).where("english or passage").drop("english"), "measures")

    rated = table(spark, root, "doc_labels").where("reading_level is not null").select("doc_id", "rater", "reading_level").distinct()
    labels = rated.orderBy(F.md5(F.concat_ws("/", "doc_id", "rater"))).limit(PARAMS.labelled).select(F.lit(False).alias("passage"), F.col("doc_id").alias("id"), "reading_level")
    return measures, labels.unionByName(given.select(F.lit(True).alias("passage"), F.col("passage_id").alias("id"), "reading_level"))


def _levels(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, x0, ..., level) of each English prose text."""
    measures, labels = _measures(spark, root)
    calibration = calibrated(measures.join(labels, KEY), "reading_level", PARAMS)
    return with_level(measures.where("not passage").drop("passage").withColumnRenamed("id", "doc_id"), calibration, PARAMS)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _levels(spark, root).where("level = 5").select("doc_id")


def p8_levels(spark: SparkSession, root: str) -> DataFrame:
    """Each document; what isn't English prose has NULL for its level."""
    ranks = [F.round(F.exp(f"x{i}")).cast("long").alias(f"rank_{round(100 * s)}") for i, s in enumerate(PARAMS.shares)]
    levels = _levels(spark, root).select("doc_id", "level", *ranks, F.round(F.exp(f"x{len(ranks)}"), 3).alias("words_a_sentence"))
    return table(spark, root, "documents").select("doc_id").where("doc_id is not null").join(levels, "doc_id", "left")


def p8_level_profile(spark: SparkSession, root: str) -> DataFrame:
    """How many texts of each level a source has; those without a level are no English prose."""
    docs = table(spark, root, "documents").select("doc_id", "source").where("doc_id is not null")
    return docs.join(_levels(spark, root).select("doc_id", "level"), "doc_id", "left").groupBy("source", "level").agg(F.count("*").alias("n_docs"))


def p8_heldout_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """How well levels agree with raters' opinions that took no part in the calibration: those of a fifth of the rated documents, by hash."""
    measures, labels = _measures(spark, root)
    held = ~F.col("passage") & (F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    calibration = calibrated(measures.join(labels.where(~held), KEY), "reading_level", PARAMS)
    judged = with_level(measures.join(labels.where(held), KEY), calibration, PARAMS)
    off = F.abs(F.col("level") - F.col("reading_level"))
    return judged.agg(F.count("*").alias("n_opinions"), F.round(F.avg((off == 0).cast("int")), 4).alias("same"), F.round(F.avg((off <= 1).cast("int")), 4).alias("within_one")).where("n_opinions > 0")


QUERIES = {"p8_found": p8_found, "p8_levels": p8_levels, "p8_level_profile": p8_level_profile, "p8_heldout_accuracy": p8_heldout_accuracy}
ORACLE: dict[str, str] = {}
