"""Samples, splits and folds. Orders come from a seed and a key alone, so that row order and partitions don't matter."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wafergrid.operators.cumulative import join_groups, running_totals
from wafergrid.operators.metrics import exact_quantiles


def seeded(seed: int, key: Column) -> Column:
    """A fixed order of hashes of a seed and a key; any engine with MD5 has the same."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_places(df: DataFrame, by: Sequence[str], key: str, seed: int, place: str = "place") -> DataFrame:
    """``df`` with the place of each row in seeded order within ``by``, from 1, and the size of its group as ``<place>_of``.

    Hashes are cut into 256 ranges by their first digits; a group is numbered range by range, so a hot one isn't
    sorted in one task. NULL is a group like any other.
    """
    h = seeded(seed, F.col(key))
    df = df.withColumn("__h", h).withColumn("__range", F.substring(h, 1, 2))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__h", key))
    sizes = df.groupBy(*by, "__range").agg(F.count("*").alias("__m"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__m").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of at most 256 rows
    sizes = sizes.select(*by, "__range", before.alias("__before"), F.sum("__m").over(group).alias(f"{place}_of"))
    out = join_groups(df.withColumn("__within", within), sizes, [*by, "__range"])
    return out.withColumn(place, (F.col("__within") + F.col("__before")).cast("int")).drop("__h", "__range", "__within", "__before")


def first_k(df: DataFrame, by: Sequence[str], key: str, k: int, seed: int) -> DataFrame:
    """The first ``k`` rows of each group in seeded order, with their ``place``: fewer if the group has fewer, and the first of any larger ``k``."""
    w = Window.partitionBy(*by).orderBy(seeded(seed, F.col(key)), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def too_small(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by..., n) of the groups with fewer than ``k`` rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") < k)


def few_shots(df: DataFrame, by: Sequence[str], key: str, k: int, seed: int) -> DataFrame:
    """As ``first_k``; a group with fewer than ``k`` different keys fails when it is read."""
    chosen = first_k(df, by, key, k, seed)
    n = F.count("*").over(Window.partitionBy(*by))  # of at most k rows
    named = F.concat(F.lit(f"fewer than {k} samples in "), F.to_json(F.struct(*by)))
    return chosen.withColumn("place", F.when(n >= k, F.col("place")).otherwise(F.raise_error(named).cast(chosen.schema["place"].dataType)))


def train_validation(df: DataFrame, by: Sequence[str], key: str, split: str, ratio: float, seed: int) -> DataFrame:
    """``df`` with a part of each group's train rows turned to 'val': the rounded fraction, at least 1, and not the last one; other rows stay."""
    placed = seeded_places(df, [*by, split], key, seed, "__place")
    want = F.least(F.greatest(F.lit(1), F.bround(F.col("__place_of") * F.lit(ratio))), F.col("__place_of") - 1)
    moved = (F.col(split) == "train") & (F.lit(ratio) > 0) & (F.col("__place") <= want)
    return placed.withColumn(split, F.when(moved, "val").otherwise(F.col(split))).drop("__place", "__place_of")


def k_folds(df: DataFrame, by: Sequence[str], key: str, split: str, folds: int, seed: int) -> DataFrame:
    """``df`` once for each fold with ``fold`` and ``fold_split``: a train row is 'val' in one fold and 'dev' in the others, any other row 'test' in all."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    train = F.coalesce(F.col(split) == "train", F.lit(False))
    placed = seeded_places(df.withColumn("__train", train), [*by, "__train"], key, seed, "__place")
    out = placed.withColumn("__own", (F.col("__place") - 1) % folds).drop("__place", "__place_of", "__train").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return out.withColumn("fold_split", F.when(~train, "test").when(F.col("__own") == F.col("fold"), "val").otherwise("dev")).drop("__own")


def tail_validation(df: DataFrame, key: str, split: str, n_val: int) -> DataFrame:
    """``df`` with the last ``n_val`` train rows by key turned to 'val'.

    The border is found by keeping the ``n_val`` largest keys of each partition, not by numbering all rows.
    """
    last = df.where(F.col(split) == "train").select(key).orderBy(F.desc(key)).limit(n_val).withColumn("__val", F.lit(True))
    return df.join(F.broadcast(last) if n_val <= 100_000 else last, key, "left").withColumn(split, F.when((F.col(split) == "train") & F.col("__val"), "val").otherwise(F.col(split))).drop("__val")


def interleaved(df: DataFrame, by: Sequence[str], label: str, key: str) -> DataFrame:
    """Rows of label 1 and 0 with their ``place`` when they take turns in the order of ``key``, 1 first; rows of another label are left out.

    ``key`` is unique within a group and label. The place follows from a row's turn and the number of rows of the other
    label. Turns are counted in ranges of the key.
    """
    good = df.where(F.col(label).isin(0, 1)).withColumn("__one", F.lit(1))
    turns = running_totals(good, [*by, label], key, ["__one"], suffix="_turn")
    other = good.groupBy(*by).agg(F.count_if(F.col(label) == 0).alias("__n0"), F.count_if(F.col(label) == 1).alias("__n1"))
    j = join_groups(turns, other, by)
    t = F.col("__one_turn")
    place = F.when(F.col(label) == 1, t + F.least(t - 1, F.col("__n0"))).otherwise(t + F.least(t, F.col("__n1")))
    return j.select(*[c for c in df.columns], place.cast("int").alias("place"))


def multilabel_folds(df: DataFrame, key: str, labels: str, folds: int, seed: int) -> DataFrame:
    """(key, fold): rows dealt so that each label is even over the folds.

    Rows of one label come first, by label in seeded order; then those of several, the most labels first. Each goes to
    the fold that has the least of its labels (repeats count), then the least rows, then the lowest number. This is one
    sequence over all rows and runs in one task.
    """
    kind = df.schema[key].dataType.simpleString()

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, sorted(map(str, v)), h) for k, v, h in zip(pdf[key], pdf["__labels"], pdf["__h"])]
        single = sorted((r for r in rows if len(r[1]) == 1), key=lambda r: (r[1][0], r[2], r[0]))
        several = sorted((r for r in rows if len(r[1]) != 1), key=lambda r: (-len(r[1]), r[0]))
        sizes, held, out = [0] * folds, [{} for _ in range(folds)], []
        for k, own, _ in [*single, *several]:
            f = min(range(folds), key=lambda i: (sum(held[i].get(x, 0) for x in own), sizes[i], i))
            sizes[f] += 1
            for x in own:
                held[f][x] = held[f].get(x, 0) + 1
            out.append((k, f))
        return pd.DataFrame(out, columns=[key, "fold"])

    rows = df.select(key, F.col(labels).cast("array<string>").alias("__labels"), seeded(seed, F.col(key)).alias("__h"), F.lit(1).alias("__all"))
    return rows.groupBy("__all").applyInPandas(deal, f"{key} {kind}, fold int")


def extremes(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str], n: int) -> DataFrame:
    """The ``n`` highest ('success') and ``n`` lowest ('failure') rows of each group, with ``role`` and ``place``."""
    out = []
    for role, order in (("success", F.desc(value)), ("failure", F.asc(value))):
        w = Window.partitionBy(*by).orderBy(order, *ties)
        out.append(df.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("role", F.lit(role)))
    return out[0].unionByName(out[1])


def tertiles(df: DataFrame, value: str, eligible: Column, out: str, *, of: DataFrame | None = None) -> DataFrame:
    """``df`` with a stratum: 'small', 'medium', 'large' at the exact thirds of the eligible rows, edges belonging to the lower one; 'single' for all if there are fewer than 3 or the edges are equal; 'normal' for other rows.

    ``of`` has the rows whose thirds count, if not those of ``df``: where ``df`` has several rows a sample, say, the samples. It isn't joined.
    """
    edges = exact_quantiles((df if of is None else of).where(eligible), [], value, [1 / 3, 2 / 3]).first()
    n, low, high = edges or (0, None, None)
    if n < 3 or low == high:
        return df.withColumn(out, F.when(eligible, "single").otherwise("normal"))
    return df.withColumn(out, F.when(~F.coalesce(eligible, F.lit(False)), "normal").when(F.col(value) <= low, "small").when(F.col(value) <= high, "medium").otherwise("large"))
