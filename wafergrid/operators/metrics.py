"""Scores against binary targets: ranks, ROC-AUC, threshold sweeps, calibration, confusion metrics, region overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wafergrid.operators.cumulative import join_groups, running_totals
from wafergrid.session import written


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def score_counts(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by..., score, pos, neg): rows of label 1 and 0 at each score. Rows with a label or score that is NULL, or a score that isn't finite, are left out."""
    good = df.where(finite(F.col(score)) & F.col(label).isin(0, 1))
    return good.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., value, n, avg_rank): the mean of the ranks 1, 2, ... that equal values take together."""
    counts = df.where(finite(F.col(value))).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = running_totals(counts, by, value, ["n"])
    return upto.select(*by, value, "n", (F.col("n_upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"))


def roc_auc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by..., n_pos, n_neg, auc): Mann-Whitney with average ranks; NULL if a group has one class only."""
    upto = running_totals(score_counts(df, by, label, score), by, "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / F.lit(2.0)))
    out = upto.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(*by, "n_pos", "n_neg", F.when(both, F.col("won") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


def threshold_candidates(df: DataFrame, by: Sequence[str], score: str, most: int | None) -> DataFrame:
    """(by..., threshold): the distinct scores of a group, or ``most`` evenly spaced values from the highest to the lowest if there are more."""
    distinct = df.where(finite(F.col(score))).select(*by, F.col(score).cast("double").alias("threshold")).distinct()
    if most is None:
        return distinct
    span = distinct.groupBy(*by).agg(F.count("*").alias("n"), F.max("threshold").alias("hi"), F.min("threshold").alias("lo"))
    i = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    if not by:
        few = span.first()["n"] <= most
        spaced = span.withColumn("i", i).select((F.col("hi") + F.col("i") * (F.col("lo") - F.col("hi")) / F.lit(float(max(1, most - 1)))).alias("threshold"))
        return distinct if few else spaced
    spaced = span.where(F.col("n") > most).withColumn("i", i).select(*by, (F.col("hi") + F.col("i") * (F.col("lo") - F.col("hi")) / F.lit(float(max(1, most - 1)))).alias("threshold"))
    kept = join_groups(distinct, span.where(F.col("n") <= most).select(*by, F.lit(True).alias("__few")), by)
    return kept.select(*by, "threshold").unionByName(spaced)


def counts_at_thresholds(counts: DataFrame, thresholds: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by..., threshold, values...): the totals of ``values`` of all scores at or above each threshold.

    Thresholds and scores are put into one order and run through once, instead of once a threshold.
    """
    zero = [F.lit(0).alias(v) for v in values]
    points = counts.select(*by, F.col("score").alias("v"), *values, F.lit(0).alias("t")).unionByName(thresholds.select(*by, F.col("threshold").alias("v"), *zero, F.lit(1).alias("t")))
    points = points.groupBy(*by, "v").agg(*[F.sum(v).alias(v) for v in values], F.max("t").alias("t"))
    upto = running_totals(points, by, "v", values, descending=True)
    return upto.where("t = 1").select(*by, F.col("v").alias("threshold"), *[F.col(f"{v}_upto").alias(v) for v in values])


def best_f1(df: DataFrame, by: Sequence[str], label: str, score: str, most: int | None = 512) -> DataFrame:
    """(by..., threshold, f1, iou, n_thresholds): the threshold of the highest F1 when ``score >= threshold`` is predicted, the highest of equals.

    Without any positive row F1 and IoU are 0; groups without a usable row are missing.
    """
    counts = score_counts(df, by, label, score)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"))
    at = counts_at_thresholds(counts, threshold_candidates(counts, by, "score", most), by, ["pos", "neg"])
    at = join_groups(at, totals, by) if by else at.withColumn("all_pos", F.lit(totals.first()[0]).cast("long"))
    tp, fp, fn = F.col("pos"), F.col("neg"), F.col("all_pos") - F.col("pos")
    f1 = F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    iou = F.when(tp > 0, tp / (tp + fp + fn)).otherwise(0.0)
    best = F.max_by(F.struct("threshold", "f1", "iou"), F.struct("f1", "threshold"))
    if not by:
        at = at.withColumn("__all", F.lit(1))  # grouped, so that no row gives none
        return at.withColumn("f1", f1).withColumn("iou", iou).groupBy("__all").agg(best.alias("b"), F.count("*").alias("n_thresholds")).select("b.threshold", "b.f1", "b.iou", "n_thresholds")
    return at.withColumn("f1", f1).withColumn("iou", iou).groupBy(*by).agg(best.alias("b"), F.count("*").alias("n_thresholds")).select(*by, "b.threshold", "b.f1", "b.iou", "n_thresholds")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """(by..., n, q0, q1, ...): exact quantiles with linear interpolation, of the finite values.

    Values are counted before they move, and their order is cut into ranges: no task holds all values of a group.
    """
    v = F.col(value).cast("double")
    counts = df.where(finite(F.col(value))).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n"))
    upto = running_totals(counts, by, "__v", ["__n"])
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("n"))
    upto = join_groups(upto, totals, by) if by else upto.withColumn("n", F.lit(totals.first()[0]).cast("long"))
    aggs = []
    for i, q in enumerate(quantiles):
        at = (F.col("n") - 1) * F.lit(float(q))
        for part, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.min(F.when(F.col("__n_upto") > rank, F.col("__v"))).alias(f"__{part}{i}"))
    found = (upto.groupBy(*by) if by else upto.groupBy(F.lit(1).alias("__all"))).agg(F.first("n").alias("n"), *aggs)
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in quantiles]
    return found.select(*by, "n", *[(F.col(f"__lo{i}") + (a - F.floor(a)) * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(f"q{i}") for i, a in enumerate(at)])


def normal_threshold(df: DataFrame, by: Sequence[str], score: str, quantile: float = 0.995) -> DataFrame:
    """(by..., threshold, n_scores): the exact quantile with linear interpolation, of the finite scores given (those of normal validation rows)."""
    if not 0 < quantile < 1:
        raise ValueError("quantile lies between 0 and 1")
    return exact_quantiles(df, by, score, [quantile]).select(*by, F.col("q0").alias("threshold"), F.col("n").alias("n_scores"))


def not_calibratable(df: DataFrame, label: str, split: str) -> DataFrame:
    """Rows that a calibration must not see: all but normal validation rows."""
    return df.where(~F.coalesce((F.col(label) == 0) & (F.col(split) == "val"), F.lit(False)))


def confusion(df: DataFrame, by: Sequence[str], pred: str, target: str) -> DataFrame:
    """(by..., tp, fp, fn, precision, recall, f1, iou) of 0/1 columns (NULL counts as 0); where both are empty the four ratios are 1."""
    p, t = F.coalesce(F.col(pred), F.lit(0)) > 0, F.coalesce(F.col(target), F.lit(0)) > 0
    out = df.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return out.select("*", *ratios("tp", "fp", "fn", empty=1.0))


def ratios(tp: str, fp: str, fn: str, *, empty: float, prefix: str = "") -> list[Column]:
    a, b, c = F.col(tp).cast("double"), F.col(fp), F.col(fn)
    none = (a + b + c) == 0
    part = lambda bottom: F.when(none, empty).when(bottom == 0, 0.0).otherwise(a / bottom)
    f1 = F.when(none, empty).when(a == 0, 0.0).otherwise(2 * a / (2 * a + b + c))
    return [part(a + b).alias(f"{prefix}precision"), part(a + c).alias(f"{prefix}recall"), f1.alias(f"{prefix}f1"), part(a + b + c).alias(f"{prefix}iou")]


def summarize_confusion(per_image: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by..., n_images, n_anomalous, micro_*, mean_*, mean_anomaly_*): micro from summed counts (0 where undefined), macro as means over images and over anomalous images (NULL without any)."""
    names = ("precision", "recall", "f1", "iou")
    bad = F.col(label) == 1
    sums = per_image.groupBy(*by).agg(
        F.count("*").alias("n_images"), F.count_if(bad).alias("n_anomalous"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        *[F.avg(c).alias(f"mean_{c}") for c in names], *[F.avg(F.when(bad, F.col(c))).alias(f"mean_anomaly_{c}") for c in names],
    )
    return sums.select(*by, "n_images", "n_anomalous", *ratios("tp", "fp", "fn", empty=0.0, prefix="micro_"), *[f"mean_{c}" for c in names], *[f"mean_anomaly_{c}" for c in names])


def sample_rows(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` rows, the first in a fixed order of hashes: the same on each run, without replacement."""
    return df.orderBy(*order).limit(most)


def region_overlap_score(pixels: DataFrame, regions: DataFrame, image: str, score: str, target: str, *, max_fpr: float = 0.3, most: int = 256) -> DataFrame:
    """(n_regions, n_negative, aupro): area below the curve of mean region overlap over the false-positive rate up to ``max_fpr``, divided by it.

    ``regions``: (image, x, y, region) of the target pixels. NULL without a region or a negative pixel.
    """
    if not 0 < max_fpr <= 1:
        raise ValueError("max_fpr lies above 0 and at most at 1")
    good, regions = pixels.where(finite(F.col(score))), written(regions.select(image, "x", "y", "region"), "regions")
    sizes = regions.groupBy(image, "region").agg(F.count("*").alias("size"))
    share = regions.join(sizes, [image, "region"]).select(image, "x", "y", (1 / F.col("size")).alias("share"))
    joined = good.join(share, [image, "x", "y"], "left")
    counts = joined.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.when(F.col(target) == 1, 0).otherwise(1)).alias("neg"), F.sum(F.coalesce("share", F.lit(0.0))).alias("share"))
    at = counts_at_thresholds(counts, threshold_candidates(counts, [], "score", most), [], ["neg", "share"])
    n_negative, n_regions = good.agg(F.count_if(F.col(target) == 0)).first()[0], sizes.count()
    found = F.lit(n_regions).alias("n_regions"), F.lit(n_negative).alias("n_negative")
    if not n_negative or not n_regions:
        return pixels.sparkSession.range(1).select(*found, F.lit(None).cast("double").alias("aupro"))
    curve = at.groupBy((F.col("neg") / F.lit(n_negative)).alias("fpr")).agg(F.max(F.col("share") / F.lit(n_regions)).alias("pro"))
    curve = curve.unionByName(curve.agg(F.min("fpr").alias("fpr")).where("fpr > 0").select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("pro")))
    order = Window.orderBy("fpr")  # at most ``most`` + 1 points
    curve = curve.select("fpr", "pro", F.lag("fpr").over(order).alias("x0"), F.lag("pro").over(order).alias("y0"), F.max("fpr").over(Window.partitionBy()).alias("last"))
    end = F.least("fpr", F.lit(max_fpr))
    height = F.when(F.col("fpr") <= max_fpr, F.col("pro")).otherwise(F.col("y0") + (F.lit(max_fpr) - F.col("x0")) / (F.col("fpr") - F.col("x0")) * (F.col("pro") - F.col("y0")))
    piece = F.when(F.col("x0") < max_fpr, (end - F.col("x0")) * (F.col("y0") + height) / 2).otherwise(0.0)
    tail = F.when((F.col("fpr") == F.col("last")) & (F.col("fpr") < max_fpr), (F.lit(max_fpr) - F.col("fpr")) * F.col("pro")).otherwise(0.0)
    return curve.agg((F.sum(F.coalesce(piece, F.lit(0.0)) + tail) / max_fpr).alias("aupro")).select(*found, "aupro")
