"""Keyed joins with stated rules for repeated and missing keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the last in ``order``; pre-aggregated before the shuffle, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("__r")).select(*key, *[F.col("__r")[c].alias(c) for c in rest])


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., n) of the keys met more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` itself, or ValueError naming a repeated key."""
    bad = repeated_keys(df, key).limit(1).collect()
    if bad:
        raise ValueError(f"repeated key {bad[0].asDict()}")
    return df


def empty_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c.cast("string"))) > 0, c)


def fill_from(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``left`` with NULL and blank ``columns`` filled from the last right row of the same key. Left rows without one stay; other right columns don't enter, whatever they are called."""
    r = last_of_each(right.select(*dict.fromkeys([*key, *order, *columns])), key, order).select(*[F.col(k).alias(f"__k_{k}") for k in key], *[F.col(c).alias(f"__r_{c}") for c in columns])
    out = left.join(r, [left[k] == r[f"__k_{k}"] for k in key], "left")
    return out.select(*[F.coalesce(empty_to_null(F.col(c)), empty_to_null(F.col(f"__r_{c}"))).alias(c) if c in columns else left[c] for c in left.columns])


def paired(baseline: DataFrame, candidate: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key..., baseline, candidate) of the keys that both have; ``paired_strictly`` demands the same keys of both."""
    return baseline.select(*key, F.col(value).alias("baseline")).join(candidate.select(*key, F.col(value).alias("candidate")), list(key))


def _one_row_a_key(df: DataFrame, key: Sequence[str], side: str) -> DataFrame:
    """(key..., r): the row of each key as a struct; a key met twice, or with a NULL, fails when it is read."""
    named = F.concat(F.lit(f"{side}: repeated or missing key "), F.to_json(F.struct(*key)))
    twice = (F.count("*") > 1) | F.max(F.when(F.greatest(*[F.col(k).isNull() for k in key], F.lit(False)), True).otherwise(False))
    rest = F.struct(*[c for c in df.columns if c not in key])
    kind = df.select(rest.alias("r")).schema["r"].dataType
    return df.groupBy(*key).agg(F.first(rest).alias("r"), twice.alias("__twice")).select(*key, F.when(F.col("__twice"), F.raise_error(named).cast(kind)).otherwise(F.col("r")).alias("r"))


def matched(sides: Mapping[str, DataFrame], key: Sequence[str], *, optional: Sequence[str] = ()) -> DataFrame:
    """(key..., a struct for each side): rows of several relations by a key that each has once.

    A repeated key, and a key that a side lacks, fail when they are read and are named; NULL is no key. A side among
    ``optional`` may have keys more than the others, which are left out. The checks are part of the one join.
    """
    out, names = None, list(sides)
    for name, df in sides.items():
        r = _one_row_a_key(df, key, name).withColumnRenamed("r", name)
        out = r if out is None else out.join(r, list(key), "full")
    needed = [n for n in names if n not in optional]
    if optional:
        out = out.where(F.greatest(*[F.col(n).isNotNull() for n in needed], F.lit(False)))
    lacking = F.concat_ws(", ", *[F.when(F.col(n).isNull(), F.lit(n)) for n in names])
    named = F.concat(F.lit("no row of "), lacking, F.lit(" for key "), F.to_json(F.struct(*key)))
    first = names[0]
    kind = out.schema[first].dataType
    whole = F.when(lacking == "", F.col(first)).otherwise(F.raise_error(named).cast(kind))
    return out.withColumn(first, whole)


def paired_strictly(baseline: DataFrame, candidate: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key..., baseline, candidate): both sides have the same keys, each once; anything else fails when it is read (see ``matched``)."""
    found = matched({"baseline": baseline.select(*key, F.col(value).alias("v")), "candidate": candidate.select(*key, F.col(value).alias("v"))}, key)
    return found.select(*key, F.col("baseline.v").alias("baseline"), F.col("candidate.v").alias("candidate"))


def missing_partners(sides: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """(key..., missing): the keys that not every side has, once, with the names of the sides that lack them."""
    out = None
    for name, df in sides.items():
        r = df.select(*key).distinct().withColumn(f"__{name}", F.lit(True))
        out = r if out is None else out.join(r, list(key), "full")
    lacking = F.concat_ws(",", *[F.when(F.col(f"__{n}").isNull(), F.lit(n)) for n in sides])
    return out.select(*key, lacking.alias("missing")).where("missing <> ''")


def required_but_missing(required: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key...): what is required but not observed; none if the required set lies within the observed one."""
    return required.select(*key).distinct().join(observed.select(*key).distinct(), list(key), "left_anti")


def bag_union(parts: Mapping[str, DataFrame], source: str = "source") -> DataFrame:
    """The rows of all relations with the name of theirs; a column that one lacks is NULL there. Repeated rows stay."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(source, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def join_groups_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` in which NULL equals NULL; the left's keys stay."""
    renamed = right.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"__j{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, on, "left").drop(*[f"__j{i}" for i in range(len(keys))])


def unmatched(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., side): keys that only one side has; both sides are compared as sets."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, list(key), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(key), "left_anti").withColumn("side", F.lit("right")))


def cached_or_computed(wanted: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """The cache's rows of the wanted keys, and ``compute(missing keys)`` for those it hasn't got."""
    keys = wanted.select(key).distinct()
    hits = cache.join(keys, key, "left_semi")
    return hits.unionByName(compute(keys.join(cache.select(key), key, "left_anti")))
