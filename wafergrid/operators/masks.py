"""Masks as 0/1 columns of pixel rows, or as sets of cells: proposals, agreement, fusion, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wafergrid.operators.metrics import confusion, ratios


def proposal(score: Column, threshold: Column) -> Column:
    """1 where a pixel is proposed: at or above the threshold, and above 0 where the threshold isn't."""
    return F.when((score >= threshold) & ((threshold > 0) | (score > 0)), 1).otherwise(0)


def predicted(score: Column, threshold: Column) -> Column:
    """1 where a pixel is predicted at evaluation: at or above the threshold, whatever its sign."""
    return F.when(score >= threshold, 1).otherwise(0)


def agreement(df: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """(by..., first_pixels, second_pixels, intersection, union, iou, expansion): IoU is 1 without any pixel; the expansion second / first is 1 if both are empty and infinite if only the first is."""
    a, b = F.col(first) > 0, F.col(second) > 0
    out = df.groupBy(*by).agg(F.count_if(a).alias("first_pixels"), F.count_if(b).alias("second_pixels"), F.count_if(a & b).alias("intersection"), F.count_if(a | b).alias("union"))
    iou = F.when(F.col("union") == 0, 1.0).otherwise(F.col("intersection") / F.col("union"))
    grown = F.when(F.col("first_pixels") > 0, F.col("second_pixels") / F.col("first_pixels")).when(F.col("second_pixels") == 0, 1.0).otherwise(float("inf"))
    return out.select("*", iou.alias("iou"), grown.alias("expansion"))


def fused(df: DataFrame, by: Sequence[str], first: str, second: str, mode: str, *, min_iou: float = 0.25, max_expansion: float = 2.0) -> DataFrame:
    """``df`` with ``fused`` (0/1) and ``source``: 'intersection', 'union', 'first', 'second', or 'selective', which takes the intersection where the masks of a group agree well enough and the first mask elsewhere."""
    a, b = (F.col(first) > 0).cast("int"), (F.col(second) > 0).cast("int")
    plain = {"intersection": a * b, "union": F.greatest(a, b), "first": a, "second": b}
    if mode in plain:
        return df.withColumn("fused", plain[mode]).withColumn("source", F.lit(mode))
    if mode != "selective":
        raise ValueError(f"unknown mode {mode}")
    good = agreement(df, by, first, second).select(*by, ((F.col("iou") >= min_iou) & (F.col("expansion") <= max_expansion)).alias("__good"))
    out = df.join(good, list(by))
    return out.withColumn("fused", F.when(F.col("__good"), a * b).otherwise(a)).withColumn("source", F.when(F.col("__good"), "intersection").otherwise("first")).drop("__good")


def union_of_masks(cells: DataFrame, image: str) -> DataFrame:
    """(image, x, y) of the cells of any mask, once."""
    return cells.select(image, "x", "y").distinct()


def difference_counts(df: DataFrame, by: Sequence[str], predicted_: str, raw: str, proposal_: str) -> DataFrame:
    """(by..., outside_raw, outside_proposal, inexact): pixels of a prediction outside the raw mask, outside the proposal, and where it isn't their intersection."""
    p, r, q = F.col(predicted_) > 0, F.col(raw) > 0, F.col(proposal_) > 0
    return df.groupBy(*by).agg(F.count_if(p & ~r).alias("outside_raw"), F.count_if(p & ~q).alias("outside_proposal"), F.count_if(p != (r & q)).alias("inexact"))


def paper_row(evidence: Column, refiner: Column, raw_source: Column) -> Column:
    """True for rows that a paper may rest on: real evidence, refined by the model, from the model's own raw mask. NULL counts as something else."""
    return F.coalesce((evidence == "paper_evidence") & (refiner == "sam2") & (raw_source == "sam2"), F.lit(False))


def evaluated(rows: DataFrame, key: Sequence[str], pred: str, target: str, label: str, cells: DataFrame, path: str) -> DataFrame:
    """(key..., label, tp, fp, fn, precision, recall, f1, iou) of mask rows, which name the cells of their masks in ``cells`` (path, x, y) by path.

    Rows without a prediction (NULL or blank path) are passed over. Normal rows without a target are compared with an
    empty mask; an anomalous row without one fails when it is read. Keys must be unique.
    """
    p, t = (F.nullif(F.trim(F.col(c)), F.lit("")) for c in (pred, target))
    named = F.concat(F.lit("an anomalous row without a target: "), F.to_json(F.struct(*key)))
    lacking = (F.col("__t").isNull()) & (F.coalesce(F.col(label), F.lit(0)) != 0)
    r = rows.select(*key, F.col(label), p.alias("__p"), t.alias("__t")).where("__p is not null")
    r = r.withColumn("__t", F.when(lacking, F.raise_error(named).cast("string")).otherwise(F.col("__t")))
    own = cells.select(F.col(path).alias("__path"), "x", "y").distinct()
    side = lambda c, n: r.select(*key, F.col(c).alias("__path")).join(own, "__path").select(*key, "x", "y", F.lit(1).alias(n))
    both = side("__p", "p").join(side("__t", "t"), [*key, "x", "y"], "full")
    found = confusion(both, key, "p", "t").select(*key, "tp", "fp", "fn")
    out = r.select(*key, F.when(F.coalesce(F.col("__t"), F.lit("")) != "\0", F.col(label)).alias(label)).join(found, list(key), "left").na.fill(0, ["tp", "fp", "fn"])  # reads the target, so that a missing one fails here too
    return out.select(*key, label, "tp", "fp", "fn", *ratios("tp", "fp", "fn", empty=1.0))


def run_spans(df: DataFrame, key: Sequence[str], runs: str) -> DataFrame:
    """(key..., start, stop): the spans of a mask that is given as run lengths, 'off,on,off,...', counted along its cells. Blank lengths are passed over; NULL has no spans."""
    lengths = F.transform(F.filter(F.split(runs, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    r = df.select(*key, F.posexplode(lengths).alias("__i", "__n"))
    upto = F.sum("__n").over(Window.partitionBy(*key).orderBy("__i"))  # of the runs of one mask
    return r.withColumn("stop", upto).where("__i % 2 = 1 and __n > 0").select(*key, (F.col("stop") - F.col("__n")).alias("start"), "stop")


def span_counts(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., first_cells, second_cells, both, differing) of two masks given as spans (see ``run_spans``); keys without any span are missing.

    The ends of all spans are put in order and run through once, so masks are never drawn cell by cell.
    """
    ends = lambda df, a: df.select(*key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*key, "e.at", (F.col("e.d") * a).alias("a"), (F.col("e.d") * (1 - a)).alias("b"))
    steps = ends(first, 1).unionByName(ends(second, 0)).groupBy(*key, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*key).orderBy("at")  # of the ends of two masks
    steps = steps.select(*key, (F.lead("at").over(w) - F.col("at")).alias("n"), (F.sum("a").over(w) > 0).alias("a"), (F.sum("b").over(w) > 0).alias("b"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return steps.groupBy(*key).agg(n(F.col("a")).alias("first_cells"), n(F.col("b")).alias("second_cells"), n(F.col("a") & F.col("b")).alias("both"), n(F.col("a") != F.col("b")).alias("differing"))
