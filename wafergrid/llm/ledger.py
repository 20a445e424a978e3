"""Samples that stay the same on every rerun and partitioning, and keep what they hold when records are added.

Method: a persisted selection ledger. What was selected before is kept by join; where the quota of a group has grown
or isn't filled yet, the unseen keys fill it, those of the earliest delivery first and within a delivery those of the
lowest hash priority. The priority depends on the seed and the key alone, never on row order or partitions.

A saved ledger is a folder to which each call that selects something adds one table; nothing in it is changed or taken
away. A record that comes late with the number of an early delivery competes for open places only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wafergrid.session import published, published_names, written


def priority(seed: Column, key: Column) -> Column:
    """Evenly spread hexadecimal digits of a seed and a key; other engines work out the same ones."""
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def selected(ledger: DataFrame | None, candidates: DataFrame, quotas: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """(group..., key, step, place, priority): what a ledger gains by ``candidates`` (group..., key, step, priority), of any number of deliveries.

    ``quotas``: group..., quota; groups without a quota, NULL keys and steps, and repeated candidates add nothing (the
    earliest step counts); a quota below what is held takes nothing away. ``place`` counts from 1 in the order of
    selection. No task holds more rows of a group than the largest quota, however many candidates the group has.
    """
    group = list(group)
    quota = quotas.where("quota is not null").groupBy(*group).agg(F.max("quota").alias("quota"))
    largest = quota.agg(F.max("quota")).first()[0] or 0
    if ledger is None:
        open_, unseen = quota.withColumn("held", F.lit(0).cast("long")), candidates
    else:
        counts = ledger.groupBy(*group).agg(F.max("place").cast("long").alias("held"))
        open_ = quota.join(counts, group, "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
        unseen = candidates.join(ledger.select(*group, key), [*group, key], "left_anti")
    unseen = unseen.where(F.col(key).isNotNull() & F.col("step").isNotNull()).groupBy(*group, key).agg(F.min(F.struct("step", "priority")).alias("f"))
    fresh = unseen.join(open_.where("quota > held"), group).select(*group, key, "f.step", "f.priority", "quota", "held")
    best = F.row_number().over(Window.partitionBy(*group).orderBy("step", "priority", key))
    fresh = fresh.withColumn("n", best).where(F.col("n") <= int(largest))  # a constant limit is kept already before the shuffle
    fresh = fresh.where(F.col("n") <= F.col("quota") - F.col("held"))
    return fresh.select(*group, key, F.col("step").cast("int").alias("step"), (F.col("held") + F.col("n")).cast("long").alias("place"), "priority")


def extend_ledger(ledger: DataFrame | None, candidates: DataFrame, quotas: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """The ledger with what it gains (see ``selected``)."""
    fresh = selected(ledger, candidates, quotas, group, key)
    return written(fresh if ledger is None else ledger.unionByName(fresh), "ledger")


def saved_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger saved at ``path``, or None if there is none."""
    names = published_names(spark, path)
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names]) if names else None


def extend_saved_ledger(path: str, candidates: DataFrame, quotas: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """As ``extend_ledger`` of the ledger saved at ``path``, which gains a table unless nothing is selected. Of two jobs that extend it at once, one fails."""
    spark = candidates.sparkSession
    held = saved_ledger(spark, path)
    fresh = written(selected(held, candidates, quotas, group, key), "selected")
    if held is None or fresh.limit(1).count():
        published(fresh, f"{path.rstrip('/')}/additions-{len(published_names(spark, path)):08d}")
    return saved_ledger(spark, path)
