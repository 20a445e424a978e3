"""Paths: one spelling for each stored place (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that is trimmed at both ends; unlike trim() this takes tabs, line ends and no-break spaces too.
BLANK = " \t\n\r\f\v\u0085            ​   　﻿"


def strip_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def _climbed(c: Column) -> Column:
    """``c`` (without empty parts) after each ``..`` took away the part before it; a leading slash stays."""
    parts = F.aggregate(
        F.split(c, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.when(F.startswith(c, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row: no filter on it is pushed below it, which would repeat it."""
    return df.select(*[df[c] for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def with_stored_place(df: DataFrame, path: str, base: str | None, place: str, *, store: str, project: str = "outputs") -> DataFrame:
    """``df`` with the place that ``path`` leads to, as a path below ``store``.

    Absolute paths (also ``file:``) must lie below ``store``, paths whose first part is ``project`` start there, all
    others start at the column ``base`` (None: at the store). NULL, blank paths, paths outside the store and paths
    without a base give NULL. Backslashes, repeated slashes, ``.``, ``..``, percent escapes (a broken one stays as it
    is) and white space at the ends are evened out; case is kept.
    """
    p = F.col("__p")
    whole = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    if base is None:
        based = p
    else:
        root = F.translate(F.col(base), "\\", "/")
        based = F.concat(strip_blank(root), F.lit("/"), p)
    inside = "/" + store.strip("/") + "/"
    steps = [
        F.nullif(strip_blank(F.translate(F.col(path), "\\", "/")), F.lit("")),
        F.when(F.contains(p, F.lit("%")), F.translate(whole, "\\", "/")).otherwise(p),
        F.when(F.lower(F.substring(p, 1, 5)) == "file:", F.regexp_replace(p, r"^(?i:file):/*(?=/)", "")).otherwise(p),
        F.when(F.startswith(p, F.lit(".")), F.regexp_replace(p, r"^(?:\./+)+", "")).otherwise(p),
        F.when(F.startswith(p, F.lit("/")) | F.startswith(p, F.lit(project + "/")), p).otherwise(based),
        F.when(F.contains(p, F.lit("//")) | F.contains(p, F.lit("/.")), F.regexp_replace(p, r"/(?:\.?/)+", "/")).otherwise(p),
        F.when(F.contains(p, F.lit("..")), _climbed(p)).otherwise(p),
        F.when(F.startswith(p, F.lit(inside)), F.substr(p, F.lit(len(inside) + 1))).when(~F.startswith(p, F.lit("/")), p),
    ]
    out = df
    for step in steps:
        out = out.withColumn("__p", step)
    return once(out, place, F.nullif(F.col("__p"), F.lit(""))).drop("__p")
