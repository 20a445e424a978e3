"""Running totals over an order that is too long for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wafergrid.session import written


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL; the left's keys stay."""
    renamed = right.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"__j{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, on).drop(*[f"__j{i}" for i in range(len(keys))])


def running_totals(df: DataFrame, by: Sequence[str], order: str | Sequence[str], values: Sequence[str], *, descending: bool = False, suffix: str = "_upto") -> DataFrame:
    """``df`` with the running total of each of ``values`` within ``by``, in the order of ``order`` and with its own row.

    ``order`` is one column or several, of any types that sort, together unique within ``by``. Rows are dealt into
    ranges of ``by`` and ``order`` together, as many and as long as the session's shuffles have it; totals run within a
    range, and what the group's ranges before it hold is added. So a group of any size is as many tasks as it has
    ranges. The rows are written once. No rows: no rows.
    """
    keys = [order] if isinstance(order, str) else list(order)
    keys = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    placed = written(df.repartitionByRange(*[F.col(b).asc() for b in by], *keys).withColumn("__piece", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*by, "__piece").orderBy(*keys)
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a range that the group has
    totals = placed.groupBy(*by, "__piece").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    totals = totals.select(*by, "__piece", *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    for v in values:
        placed = placed.withColumn(v + suffix, F.sum(v).over(within))
    out = join_groups(placed, totals, [*by, "__piece"])
    return out.select(*df.columns, *[(F.col(v + suffix) + F.col(f"__{v}")).alias(v + suffix) for v in values])
