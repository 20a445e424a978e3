"""Where rows are dealt anew before work that needs no shuffle."""

from __future__ import annotations

from wafergrid.llm.text_queries import spread


def test_many_splits_stay_as_they_are(spark):
    cores = spark.sparkContext.defaultParallelism
    many, few = spark.range(100).repartition(cores + 1), spark.range(100).coalesce(1)
    assert spread(many) is many and "Exchange" in spread(few)._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in spread(few).collect()) == list(range(100))
