"""Scoring of a stream of vectors against a fixed bank, and windowed summaries of a stream of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wafergrid.operators.vectors import nearest_distance


def score_stream(vectors: DataFrame, bank: DataFrame, key: str, by: str, vec: str, threshold: float) -> DataFrame:
    """(key, distance, flagged) for a stream of vectors; the bank is a static table. Stateless: late and repeated rows are scored like others."""
    return nearest_distance(vectors, bank, key, by, vec).withColumn("flagged", F.col("distance") >= threshold)


def window_summary(scores: DataFrame, time: str, score: str, *, window: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, n, mean, highest) of each window of event time; rows later than ``late`` are dropped, as the state of their window is gone."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    g = scores.withWatermark(time, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.max(score).alias("highest"))
    return g.select(F.col("w.start").alias("start"), "n", "mean", "highest")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, once, exactly once over restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
