"""Queries on what runs, rows and masks must fulfil, and on comparisons with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wafergrid.functions import text
from wafergrid.functions.paths import with_stored_place
from wafergrid.operators import joins, lineage, masks, sampling, stats
from wafergrid.plans._views import CELLS, PIXELS, RECORDS, RESULTS, SPLIT, images, paired_cells, pixels, records, run_results
from wafergrid.plans.compaction import STORE
from wafergrid.plans.result_queries import CATEGORIES, METHODS, SEEDS, SHOTS
from wafergrid.session import written
from wafergrid.sources.tables import table

KEY = ["category", "k", "seed", "variant", "sample_id"]
CELL = ["category", "k", "seed", "sample_id"]


def macro_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Means of the baseline by shots, over seeds, with intervals."""
    cells = paired_cells(spark, root).groupBy("k", "category", "seed").agg(F.avg("baseline").alias("value"))
    return stats.macro_with_intervals(cells, ["k"], "category", "seed", "value")


def _strata(spark: SparkSession, root: str) -> DataFrame:
    """The cells of anomalous samples with the tertile of their area and thinness, whose edges are those of the samples."""
    c = paired_cells(spark, root).where("label = 1")
    samples = c.select("category", "sample_id", "area", "thinness").distinct()
    for name in ("area", "thinness"):
        c = sampling.tertiles(c, name, F.lit(True), f"{name}_stratum", of=samples)
    return c.withColumn("baseline_iou", F.col("baseline") / (2 - F.col("baseline"))).withColumn("candidate_iou", F.col("candidate") / (2 - F.col("candidate")))


METRICS = {"f1": ("baseline", "candidate"), "iou": ("baseline_iou", "candidate_iou")}


def comparison_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Candidate against baseline over all anomalous samples, by shots, by category and by stratum."""
    scopes = {n: F.col(n) for n in ("k", "category", "area_stratum", "thinness_stratum")}
    return stats.comparison_intervals(_strata(spark, root), scopes, METRICS, category="category", shot="k", seed="seed", sample="sample_id")


def decision_by_intervals(spark: SparkSession, root: str) -> DataFrame:
    """The rule of decision by category, fed with the intervals of F1 and IoU."""
    found = stats.comparison_intervals(_strata(spark, root), {"category": F.col("category")}, METRICS, category="category", shot="k", seed="seed", sample="sample_id")
    wide = found.groupBy("scope", "level").agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in ("ci_low", "ci_high")])
    return wide.select("scope", "level", stats.decision(F.col("f1_ci_low"), F.col("f1_ci_high"), F.col("iou_ci_low"), F.col("iou_ci_high")).alias("outcome"))


def strict_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Cells of both sides, which must have the same keys."""
    c = paired_cells(spark, root).where("label = 1")
    p = joins.paired_strictly(c.select(*CELL, F.col("baseline").alias("v")), c.select(*CELL, F.col("candidate").alias("v")), CELL, "v")
    return p.select(*CELL, F.round(F.col("candidate") - F.col("baseline"), 9).alias("delta"))


def _triplet(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Scores, guided masks and fused masks of all runs by the run's parameters and the sample; of retried rows the last."""
    runs = table(spark, root, "run_specs").select("run_id", "method", "category", "k", "seed", "variant").distinct()

    def side(name: str, method: str, order: str, *columns: str) -> DataFrame:
        rows = table(spark, root, name).select("run_id", "sample_id", order, *columns).where("sample_id is not null").distinct()
        own = runs.where(F.col("method") == method).drop("method")
        return joins.last_of_each(rows.join(own, "run_id").select(*KEY, order, *columns), KEY, [order, *columns])

    row = ("evidence_class", "refiner", "raw_mask_source", "mask_output", "selected_source", "sam2_mask_path", "pred_mask_path")
    return {
        "heat": side("scores", "dinov2_multi", "score_id", "label"), "guided": side("mask_scores", "dinov2_multi_sam2", "mask_row_id", *row),
        "fused": side("mask_scores", "anomaly_consistent_sam2", "mask_row_id", *row),
    }


def triplet_missing(spark: SparkSession, root: str) -> DataFrame:
    """Samples of a run that not all three have."""
    return joins.missing_partners(_triplet(spark, root), KEY)


def triplet_join(spark: SparkSession, root: str) -> DataFrame:
    """Score row, guided and fused mask row of the samples that all three have, each once."""
    sides = {n: written(df, n) for n, df in _triplet(spark, root).items()}
    lacking = written(joins.missing_partners(sides, KEY), "lacking")
    whole = {n: df.join(lacking, KEY, "left_anti") for n, df in sides.items()}
    return joins.matched(whole, KEY).select(*KEY, "heat.score_id", "heat.label", F.col("guided.mask_row_id").alias("guided_row"), F.col("fused.mask_row_id").alias("fused_row"))


def audit_rows(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of guided and fused rows, and how many of them break the rules of provenance and of outputs."""
    sides = _triplet(spark, root)
    g, f = (sides[n].select(*KEY, F.struct(*[c for c in sides[n].columns if c not in KEY]).alias(n)) for n in ("guided", "fused"))
    j = g.join(f, KEY)
    paper = lambda n: masks.paper_row(F.col(f"{n}.evidence_class"), F.col(f"{n}.refiner"), F.col(f"{n}.raw_mask_source"))
    source = lambda n, want: F.coalesce((F.col(f"{n}.mask_output") == want) & (F.col(f"{n}.selected_source") == want), F.lit(False))
    return j.agg(
        F.count_distinct(F.struct("category", "k", "seed", "variant")).alias("runs_checked"), F.count("*").alias("images_checked"),
        F.count_if(~paper("guided") | ~paper("fused")).alias("provenance_violating_rows"), F.count_if(~source("guided", "sam2") | ~source("fused", "intersection")).alias("mask_output_violating_rows"),
    ).withColumn("ok", (F.col("provenance_violating_rows") + F.col("mask_output_violating_rows")) == 0)


def audit_masks(spark: SparkSession, root: str) -> DataFrame:
    """Cells in which stored masks break the rules: guided predictions that aren't the raw mask, fused rows whose raw mask isn't the guided one, and fused predictions outside it.

    Masks are the run lengths in the store's files; of several listings of a place that of the smallest file_id counts.
    Rows whose mask isn't stored are counted apart.
    """
    sides = _triplet(spark, root)
    roots = table(spark, root, "run_specs").groupBy("category", "k", "seed", "variant", "method").agg(F.min("output_root").alias("base"))
    rows = sides["guided"].withColumn("side", F.lit("dinov2_multi_sam2")).unionByName(sides["fused"].withColumn("side", F.lit("anomaly_consistent_sam2")))
    rows = rows.join(roots.withColumnRenamed("method", "side"), ["category", "k", "seed", "variant", "side"], "left")
    paths = F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).alias("path")) for n, c in (("raw", "sam2_mask_path"), ("pred", "pred_mask_path"))])
    named = rows.select(*KEY, F.when(F.col("side") == "dinov2_multi_sam2", "guided").otherwise("fused").alias("side"), "base", F.explode(paths).alias("p")).select(*KEY, "side", "base", "p.what", "p.path")
    named = with_stored_place(named, "path", "base", "place", store=STORE)
    files = table(spark, root, "artifact_files").where("payload is not null and file_id is not null").select("file_path", "file_id", "payload")
    files = with_stored_place(files, "file_path", None, "place", store=STORE).where("place is not null")
    files = files.groupBy("place").agg(F.min_by("payload", "file_id").alias("payload"))
    held = written(named.join(files, "place", "left").select(*KEY, F.concat_ws("_", "side", "what").alias("mask"), "payload"), "masks")
    spans = written(masks.run_spans(held.where("payload is not null"), [*KEY, "mask"], "payload"), "spans")

    def compared(first: str, second: str, name: str, count: str) -> DataFrame:
        """Of the keys that have both masks stored."""
        have = lambda m: held.where((F.col("mask") == m) & F.col("payload").isNotNull()).select(*KEY)
        both = have(first).join(have(second), KEY)
        side = lambda m: spans.where(F.col("mask") == m).drop("mask").join(both, KEY, "left_semi")
        n = masks.span_counts(side(first), side(second), KEY)
        out = both.join(n, KEY, "left").na.fill(0, ["first_cells", "both", "differing"])
        cells = F.col("differing") if count == "differing" else F.col("first_cells") - F.col("both")
        return out.agg(F.lit(name).alias("rule"), F.count("*").alias("n_images"), F.count_if(cells > 0).alias("n_violating"), F.coalesce(F.sum(cells), F.lit(0)).alias("n_cells"))

    out = compared("guided_pred", "guided_raw", "guided_pred_not_raw", "differing").unionByName(compared("fused_raw", "guided_raw", "fused_raw_not_guided_raw", "differing"))
    out = out.unionByName(compared("fused_pred", "guided_raw", "fused_outside_raw", "outside"))
    lost = held.where("payload is null").agg(F.lit("not_stored").alias("rule"), F.count("*").alias("n_images"), F.count("*").alias("n_violating"), F.lit(0).cast("long").alias("n_cells"))
    return out.unionByName(lost)


def mask_rows_evaluation(spark: SparkSession, root: str) -> DataFrame:
    """Mask rows of images, some without a prediction, normal ones without a target."""
    px = written(pixels(spark, root).select("img", "x", "y", "label", "target", "cand"), "pixels")
    rows = images(spark, root).select(
        "img", "label", F.when(F.col("img") % 7 != 0, F.concat(F.lit("p/"), "img")).otherwise(F.when(F.col("img") % 2 == 0, " ")).alias("pred"), F.when(F.col("label") == 1, F.concat(F.lit("t/"), "img")).alias("goal")
    )
    cells = px.where("cand = 1").select(F.concat(F.lit("p/"), "img").alias("path"), "x", "y").unionByName(px.where("target = 1").select(F.concat(F.lit("t/"), "img").alias("path"), "x", "y"))
    per = masks.evaluated(rows, ["img"], "pred", "goal", "label", cells, "path")
    names = ("precision", "recall", "f1", "iou")
    mean = lambda c, p, only: F.round(F.avg(F.when(only, F.col(c))), 6).alias(f"mean_{p}{c}")
    return per.agg(
        F.count("*").alias("n_images"), F.count_if(F.col("label") == 1).alias("n_anomalous"),
        *[mean(c, "", F.lit(True)) for c in names], *[mean(c, "anomaly_", F.col("label") == 1) for c in names],
    )


def matrix_filter(spark: SparkSession, root: str) -> DataFrame:
    runs = lineage.run_matrix(spark, METHODS, CATEGORIES, SHOTS, SEEDS)
    return lineage.filtered_runs(runs, method="dinov2_multi", category="pcb2")


def paper_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each refiner, and those that would be evidence if the class were that of a paper."""
    m = table(spark, root, "mask_scores").select("mask_row_id", "evidence_class", "refiner", "raw_mask_source").distinct()
    own, if_paper = masks.paper_row(F.col("evidence_class"), F.col("refiner"), F.col("raw_mask_source")), masks.paper_row(F.lit("paper_evidence"), F.col("refiner"), F.col("raw_mask_source"))
    return m.groupBy("refiner").agg(F.count("*").alias("n_rows"), F.count_if(own).alias("n_paper"), F.count_if(if_paper).alias("n_by_model"))


def report_order(spark: SparkSession, root: str) -> DataFrame:
    """Means of methods and categories in the order of a report."""
    r = run_results(spark, root)
    both = r.groupBy("method", "category").agg(F.round(F.avg("price"), 4).alias("price"))
    macro, mean = (r.groupBy("method").agg(F.round(F.avg("price"), 4).alias("price")).withColumn("category", F.lit(n)) for n in ("macro", "mean"))
    order = text.report_rank(F.col("category"), F.col("method"), ["3-MEDIUM", "1-URGENT", "5-LOW"])
    return both.unionByName(macro).unionByName(mean).withColumn("place", F.row_number().over(Window.orderBy(order)))  # a report's rows: methods times categories


def required_roles(spark: SparkSession, root: str) -> DataFrame:
    """Categories that lack one of the roles that each needs: a fold's dev, val and test rows."""
    r = records(spark, root).where("category is not null")
    need = r.select("category").distinct().withColumn("role", F.explode(F.array(*map(F.lit, ("train", "val", "test", "audit")))))
    return joins.required_but_missing(need, r.select("category", F.col("split").alias("role")), ["category", "role"])


def run_bag(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all kinds of runs put together, and what they hold by kind and label."""
    s = table(spark, root, "scores").select("run_id", "sample_id", "label", "image_score")
    m = table(spark, root, "mask_scores").select("run_id", "sample_id", "label", "mask_iou")
    g = joins.bag_union({"scores": s, "masks": m}, "kind").groupBy("kind", "label")
    return g.agg(F.count("*").alias("n_rows"), F.count("image_score").alias("n_scores"), F.count("mask_iou").alias("n_ious"), F.count_distinct("run_id").alias("n_runs"))


def calibration_recheck(spark: SparkSession, root: str) -> DataFrame:
    """The last calibration of each run beside the quantile of the run's normal validation scores."""
    t = table(spark, root, "normal_thresholds").where("threshold is not null and not isnan(threshold)").select("run_id", "calib_id", "threshold").distinct()
    t = joins.last_of_each(t, ["run_id"], ["calib_id", "threshold"])
    s = table(spark, root, "scores").select("run_id", "score_id", "label", "fold_split", "image_score").distinct()
    s = s.where((F.col("label") == 0) & (text.split_name(F.col("fold_split")) == "val"))
    out = lineage.recalibrated(t, s, ["run_id"], "threshold", "image_score", 0.995)
    return out.select("run_id", F.round("threshold", 6).alias("threshold"), "n_scores", F.round("again", 6).alias("again"), "close")


def evidence_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Rows and checksums of the tables that results rest on."""
    columns = {
        "run_specs": ["run_id", "method", "category", "fold_id", "k", "seed", "variant", "config_sha256"], "dataset_records": ["record_id", "dataset", "category", "sample_id", "split", "label"],
        "scores": ["score_id", "run_id", "sample_id", "label"], "mask_scores": ["mask_row_id", "run_id", "sample_id", "refiner"], "artifact_files": ["file_id", "file_path", "size_bytes"],
    }
    return lineage.evidence_manifest({n: (table(spark, root, n).select(*c), c) for n, c in columns.items()})


def parse_options(spark: SparkSession, root: str) -> DataFrame:
    """Flags and fractions as they are written on a command line."""
    e = table(spark, root, "events").select("event_id")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % by + 1).cast("int"))
    e = e.select("event_id", pick([" Yes", "off", "TRUE", "", None, "0"], 6).alias("a"), pick(["25%", "1/4", "0.5", None, " 1 "], 5).alias("b"))
    e = e.select(text.flag(F.col("a")).alias("flag"), text.fraction(F.col("b")).alias("fraction"))
    return e.groupBy("flag", "fraction").agg(F.count("*").alias("n"))


def matrix_report(spark: SparkSession, root: str) -> DataFrame:
    """Methods of the specified runs; a run fails that has a sample twice."""
    twice = joins.repeated_keys(table(spark, root, "scores").select("run_id", "sample_id", "score_id").distinct(), ["run_id", "sample_id"])
    return lineage.matrix_ok(table(spark, root, "run_specs"), twice)


def resume_identity(spark: SparkSession, root: str) -> DataFrame:
    """Runs that can't be resumed: with another configuration or calibrations than the specified ones."""
    specs = table(spark, root, "run_specs").groupBy("run_id").agg(F.min("config_sha256").alias("identity"))
    later = table(spark, root, "run_specs").where("k <> 2").groupBy("run_id").agg(F.min(F.when(F.col("seed") % 2 == 0, F.lit("other")).otherwise(F.col("config_sha256"))).alias("identity"))
    later = later.unionByName(spark.range(1).select(F.lit("new_run").alias("run_id"), F.lit("x").alias("identity")))
    return lineage.changed_identities(specs, later, "run_id", "identity")


def one_sided_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs that have scores or masks, but not both."""
    return joins.unmatched(table(spark, root, "scores").select("run_id"), table(spark, root, "mask_scores").select("run_id"), ["run_id"])


def grid_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Combinations of method, category, shots and seed among the runs with mask rows that have no run or, with ablations counted, several."""
    runs = table(spark, root, "run_specs").select("run_id", "method", "category", "k", "seed").distinct()
    return lineage.grid_violations(runs.join(table(spark, root, "mask_scores").select("run_id"), "run_id", "left_semi"), ["method", "category", "k", "seed"])


def reconcile_measures(spark: SparkSession, root: str) -> DataFrame:
    """Mask rows whose counts and ratios don't follow from one another, by measure."""
    m = table(spark, root, "mask_scores").select("mask_row_id", "mask_iou", "sam2_to_anomaly_area_ratio", "anomaly_pixels", "sam2_pixels", "intersection_pixels", "union_pixels").distinct()
    a, b, i, u = (F.col(f"{c}_pixels") for c in ("anomaly", "sam2", "intersection", "union"))
    pairs = {
        "union": (u, a + b - i), "iou": (F.col("mask_iou"), F.when(u == 0, 1.0).otherwise(i / F.when(u != 0, u))),
        "ratio": (F.col("sam2_to_anomaly_area_ratio"), F.when(a > 0, b / F.when(a > 0, a)).when(b == 0, 1.0).when(b > 0, float("inf"))),
    }
    off = lineage.reconciled(m, ["mask_row_id"], pairs)
    return off.groupBy("measure").agg(F.count("*").alias("n_rows"), F.count_if(F.col("reported").isNull()).alias("n_missing"), F.min("mask_row_id").alias("first_row"))


def dependency_identities(spark: SparkSession, root: str) -> DataFrame:
    """Dependencies, direct or not, whose configuration can't be told."""
    r = table(spark, root, "run_specs")
    return lineage.unmet_dependencies(r.select("run_id", "config_sha256"), r.select("run_id", F.explode("dependencies").alias("needs")), "config_sha256")


def artifact_references(spark: SparkSession, root: str) -> DataFrame:
    """Places that mask rows refer to, by what is wrong with them."""
    roots = table(spark, root, "run_specs").groupBy("run_id").agg(F.min("output_root").alias("output_root"))
    m = table(spark, root, "mask_scores").select("run_id", F.explode(F.array("pred_mask_path", "sam2_mask_path")).alias("path")).where("trim(path) <> ''")
    asked = with_stored_place(m.join(roots, "run_id", "left"), "path", "output_root", "place", store=STORE)
    files = with_stored_place(table(spark, root, "artifact_files").select("file_path", "file_id", "payload"), "file_path", None, "place", store=STORE).where("place is not null")
    found = lineage.referenced_artifacts(asked.select("place"), files.select("place", "file_id", "payload"), "payload")
    return found.groupBy("problem").agg(F.count("*").alias("n_places"), F.sum("n_references").alias("n_references"), F.count_distinct("sha256").alias("n_hashes"))


QUERIES = {
    f.__name__: f
    for f in (
        reconcile_measures, dependency_identities, artifact_references, macro_intervals, comparison_intervals, decision_by_intervals, strict_pairs, triplet_missing, triplet_join, audit_rows, audit_masks, mask_rows_evaluation, matrix_filter, paper_rows, report_order,
        required_roles, run_bag, calibration_recheck, evidence_manifest, parse_options, matrix_report, resume_identity, one_sided_runs, grid_gaps,
    )
}


def _sum(name: str, columns: list[str]) -> str:
    text_ = ", ".join(f"coalesce({c}::VARCHAR, chr(30))" for c in columns)
    return f"SELECT '{name}' AS name, count(*) AS n_rows, coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), {text_})), 1, 12))::BIGINT), 0)::HUGEINT::VARCHAR AS checksum FROM {name}"


def _oracle() -> dict[str, str]:
    from wafergrid.plans.text_queries import place_sql

    side = "SELECT category, k, seed, variant, sample_id, {cols} FROM (SELECT DISTINCT category, k, seed, variant, sample_id, {own} FROM {t} JOIN (SELECT DISTINCT run_id, method, category, k, seed, variant FROM run_specs) s USING (run_id) WHERE method = '{m}' AND sample_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY category, k, seed, variant, sample_id ORDER BY {order}) = 1"
    row = ["mask_row_id", "evidence_class", "refiner", "raw_mask_source", "mask_output", "selected_source", "sam2_mask_path", "pred_mask_path"]
    last = lambda cols: ", ".join(f"{c} DESC NULLS LAST" for c in cols)
    own = lambda t, cols: ", ".join(f"{t}.{c}" for c in cols)
    heat = side.format(cols="score_id, label", own="scores.score_id, scores.label", t="scores", m="dinov2_multi", order=last(["score_id", "label"])).replace("DISTINCT category, k", "DISTINCT s.category, k")
    guided, fused = (side.format(cols=", ".join(row), own=own("mask_scores", row), t="mask_scores", m=m, order=last(row)).replace("DISTINCT category, k", "DISTINCT s.category, k") for m in ("dinov2_multi_sam2", "anomaly_consistent_sam2"))
    triplet = f"heat AS ({heat}), guided AS ({guided}), fused AS ({fused})"
    key = "category, k, seed, variant, sample_id"
    paper = "coalesce({0}.evidence_class = 'paper_evidence' AND {0}.refiner = 'sam2' AND {0}.raw_mask_source = 'sam2', false)"
    masks_ = f"""o AS (SELECT category, k, seed, variant, method, min(output_root) AS base FROM run_specs GROUP BY ALL),
      u AS (SELECT {key}, 'guided' AS side, 'dinov2_multi_sam2' AS method, unnest([{{'what': 'raw', 'p': sam2_mask_path}}, {{'what': 'pred', 'p': pred_mask_path}}]) AS q FROM guided UNION ALL SELECT {key}, 'fused', 'anomaly_consistent_sam2', unnest([{{'what': 'raw', 'p': sam2_mask_path}}, {{'what': 'pred', 'p': pred_mask_path}}]) FROM fused),
      n AS (SELECT {key}, side || '_' || q.what AS mask, {place_sql('q.p', 'base')} AS place FROM u LEFT JOIN o USING (category, k, seed, variant, method)),
      f AS (SELECT place, arg_min(payload, file_id) AS payload FROM (SELECT file_id, payload, {place_sql('file_path', "''")} AS place FROM artifact_files WHERE payload IS NOT NULL) WHERE place IS NOT NULL GROUP BY place),
      h AS (SELECT n.* EXCLUDE (place), payload FROM n LEFT JOIN f USING (place)),
      r AS (SELECT {key}, mask, unnest(list_filter(string_split(payload, ','), lambda x: trim(x) <> ''))::BIGINT AS len, generate_subscripts(list_filter(string_split(payload, ','), lambda x: trim(x) <> ''), 1) AS i FROM h WHERE payload IS NOT NULL),
      c AS (SELECT *, sum(len) OVER (PARTITION BY {key}, mask ORDER BY i) AS stop FROM r), sp AS (SELECT {key}, mask, stop - len AS start, stop FROM c WHERE i % 2 = 0 AND len > 0),
      on_ AS (SELECT {key}, mask, unnest(range(start::BIGINT, stop::BIGINT)) AS cell FROM sp)"""

    def rule(a: str, b: str, name: str, outside: bool) -> str:
        hit = "x.mask IS NOT NULL AND y.mask IS NULL" if outside else "(x.mask IS NULL) <> (y.mask IS NULL)"
        return f"""SELECT '{name}' AS rule, count(*) AS n_images, count(*) FILTER (coalesce(n, 0) > 0) AS n_violating, coalesce(sum(n), 0)::BIGINT AS n_cells FROM (SELECT {key} FROM h WHERE mask = '{a}' AND payload IS NOT NULL) JOIN (SELECT {key} FROM h WHERE mask = '{b}' AND payload IS NOT NULL) USING ({key})
          LEFT JOIN (SELECT {key}, count(*) FILTER ({hit}) AS n FROM (SELECT * FROM on_ WHERE mask = '{a}') x FULL JOIN (SELECT * FROM on_ WHERE mask = '{b}') y USING ({key}, cell) GROUP BY {key}) USING ({key})"""

    ratios = {"precision": "tp + fp", "recall": "tp + fn", "iou": "tp + fp + fn"}
    part = {k: f"CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN {b} = 0 THEN 0.0 ELSE tp / ({b})::DOUBLE END" for k, b in ratios.items()} | {"f1": "CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END"}
    means = ", ".join(f"round(avg({part[c]}), 6) AS mean_{c}, round(avg({part[c]}) FILTER (label = 1), 6) AS mean_anomaly_{c}" for c in ("precision", "recall", "f1", "iou"))
    bag = "SELECT kind, label, count(*) AS n_rows, count(image_score) AS n_scores, count(mask_iou) AS n_ious, count(DISTINCT run_id) AS n_runs FROM (SELECT 'scores' AS kind, run_id, label, image_score, NULL AS mask_iou FROM scores UNION ALL SELECT 'masks', run_id, label, NULL, mask_iou FROM mask_scores) GROUP BY ALL"
    return {
        "reconcile_measures": """WITH m AS (SELECT DISTINCT mask_row_id, mask_iou, sam2_to_anomaly_area_ratio AS r, anomaly_pixels::DOUBLE AS a, sam2_pixels::DOUBLE AS b, intersection_pixels::DOUBLE AS i, union_pixels::DOUBLE AS u FROM mask_scores),
          l AS (SELECT mask_row_id, 'union' AS measure, u AS x, a + b - i AS y FROM m UNION ALL SELECT mask_row_id, 'iou', mask_iou, CASE WHEN u = 0 THEN 1.0 ELSE i / nullif(u, 0) END FROM m UNION ALL SELECT mask_row_id, 'ratio', r, CASE WHEN a > 0 THEN b / nullif(a, 0) WHEN b = 0 THEN 1.0 WHEN b > 0 THEN 'inf'::DOUBLE END FROM m)
          SELECT measure, count(*) AS n_rows, count(*) FILTER (x IS NULL) AS n_missing, min(mask_row_id) AS first_row FROM l WHERE NOT (x IS NOT DISTINCT FROM y OR coalesce(NOT isinf(x) AND NOT isinf(y) AND NOT isnan(x) AND NOT isnan(y) AND abs(x - y) <= greatest(1e-10 * greatest(abs(x), abs(y)), 1e-12), false)) GROUP BY measure""",
        "dependency_identities": """WITH RECURSIVE e AS (SELECT DISTINCT run_id, unnest(dependencies) AS needs FROM run_specs), reach(run_id, needs, depth) AS (SELECT run_id, needs, 1 FROM e UNION ALL SELECT r.run_id, e.needs, depth + 1 FROM reach r JOIN e ON e.run_id = r.needs),
          c AS (SELECT run_id, needs, max(depth)::INT AS depth FROM reach GROUP BY ALL), k AS (SELECT run_id AS needs, count(DISTINCT config_sha256) AS n FROM run_specs GROUP BY run_id)
          SELECT * FROM (SELECT run_id, needs, depth, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'unnamed' WHEN n > 1 THEN 'ambiguous' END AS problem FROM c LEFT JOIN k USING (needs)) WHERE problem IS NOT NULL""",
        "artifact_references": f"""WITH o AS (SELECT run_id, min(output_root) AS base FROM run_specs GROUP BY run_id), p AS (SELECT run_id, unnest([pred_mask_path, sam2_mask_path]) AS p FROM mask_scores), q AS (SELECT {place_sql('p', 'base')} AS place FROM p LEFT JOIN o USING (run_id) WHERE trim(p) <> ''),
          a AS (SELECT place, count(*) AS n_references FROM q GROUP BY place), f AS (SELECT place, count(DISTINCT file_id) AS n_files, count(DISTINCT payload) AS n_contents, min(payload) AS payload FROM (SELECT file_id, payload, {place_sql('file_path', "''")} AS place FROM artifact_files) WHERE place IS NOT NULL GROUP BY place),
          j AS (SELECT a.place, n_references, CASE WHEN a.place IS NULL THEN 'outside' WHEN coalesce(n_files, 0) = 0 THEN 'missing' WHEN n_contents > 1 THEN 'several' END AS problem, CASE WHEN n_contents = 1 THEN sha256(payload) END AS h FROM a LEFT JOIN f USING (place))
          SELECT problem, count(*) AS n_places, sum(n_references)::BIGINT AS n_references, count(DISTINCT h) AS n_hashes FROM j GROUP BY problem""",
        "strict_pairs": f"WITH {CELLS} SELECT category, k, seed, sample_id, round(candidate - baseline, 9) AS delta FROM cells WHERE label = 1",
        "triplet_missing": f"WITH {triplet}, a AS (SELECT {key} FROM heat UNION SELECT {key} FROM guided UNION SELECT {key} FROM fused) SELECT * FROM (SELECT a.*, concat_ws(',', CASE WHEN h.sample_id IS NULL THEN 'heat' END, CASE WHEN g.sample_id IS NULL THEN 'guided' END, CASE WHEN f.sample_id IS NULL THEN 'fused' END) AS missing FROM a "
        + " ".join(f"LEFT JOIN (SELECT {key} FROM {t}) {n} USING ({key})" for t, n in (("heat", "h"), ("guided", "g"), ("fused", "f"))) + ") WHERE missing <> ''",
        "triplet_join": f"WITH {triplet} SELECT {key}, score_id, label, g.mask_row_id AS guided_row, f.mask_row_id AS fused_row FROM heat JOIN guided g USING ({key}) JOIN fused f USING ({key})",
        "audit_rows": f"""WITH {triplet}, j AS (SELECT (category, k, seed, variant) AS run, NOT {paper.format('g')} OR NOT {paper.format('f')} AS a, NOT coalesce(g.mask_output = 'sam2' AND g.selected_source = 'sam2', false) OR NOT coalesce(f.mask_output = 'intersection' AND f.selected_source = 'intersection', false) AS b FROM guided g JOIN fused f USING ({key}))
          SELECT count(DISTINCT run) AS runs_checked, count(*) AS images_checked, count(*) FILTER (a) AS provenance_violating_rows, count(*) FILTER (b) AS mask_output_violating_rows, count(*) FILTER (a OR b) = 0 AS ok FROM j""",
        "audit_masks": f"WITH {triplet}, {masks_} {rule('guided_pred', 'guided_raw', 'guided_pred_not_raw', False)} UNION ALL {rule('fused_raw', 'guided_raw', 'fused_raw_not_guided_raw', False)} UNION ALL {rule('fused_pred', 'guided_raw', 'fused_outside_raw', True)} UNION ALL SELECT 'not_stored', count(*), count(*), 0 FROM h WHERE payload IS NULL",
        "mask_rows_evaluation": f"WITH {PIXELS}, p AS (SELECT img, label, count(*) FILTER (cand = 1 AND target = 1) AS tp, count(*) FILTER (cand = 1 AND target = 0) AS fp, count(*) FILTER (cand = 0 AND target = 1) AS fn FROM pixels WHERE img % 7 <> 0 GROUP BY ALL) SELECT count(*) AS n_images, count(*) FILTER (label = 1) AS n_anomalous, {means} FROM p",
        "matrix_filter": "SELECT 'dinov2_multi__pcb2__fold0__k' || k || '__seed' || seed AS run_id, 'dinov2_multi' AS method, 'pcb2' AS category, 0 AS fold_id, k, seed FROM (SELECT unnest([1, 2, 4]) AS k), (SELECT unnest(range(4880, 4885))::INT AS seed)",
        "paper_rows": "SELECT refiner, count(*) AS n_rows, count(*) FILTER (evidence_class = 'paper_evidence' AND refiner = 'sam2' AND raw_mask_source = 'sam2') AS n_paper, count(*) FILTER (refiner = 'sam2' AND raw_mask_source = 'sam2') AS n_by_model FROM (SELECT DISTINCT mask_row_id, evidence_class, refiner, raw_mask_source FROM mask_scores) GROUP BY refiner",
        "report_order": f"WITH {RESULTS}, r AS (SELECT method, category, round(avg(price), 4) AS price FROM results GROUP BY ALL UNION ALL SELECT method, 'macro', round(avg(price), 4) FROM results GROUP BY method UNION ALL SELECT method, 'mean', round(avg(price), 4) FROM results GROUP BY method) SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'macro' THEN 0 WHEN 'mean' THEN 2 ELSE 1 END, category, CASE method WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 999 END, method)::INT AS place FROM r",
        "required_roles": f"WITH {RECORDS} SELECT category, role FROM (SELECT DISTINCT category FROM records WHERE category IS NOT NULL), (SELECT unnest(['train', 'val', 'test', 'audit']) AS role) WHERE (category, role) NOT IN (SELECT (category, split) FROM records WHERE split IS NOT NULL AND category IS NOT NULL)",
        "run_bag": bag,
        "calibration_recheck": f"""WITH t AS (SELECT run_id, threshold FROM (SELECT DISTINCT run_id, calib_id, threshold FROM normal_thresholds WHERE NOT isnan(threshold)) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY calib_id DESC, threshold DESC) = 1),
          s AS (SELECT DISTINCT run_id, score_id, image_score, {SPLIT.format('fold_split')} AS split, label FROM scores), q AS (SELECT run_id, count(*) AS n, quantile_cont(image_score, 0.995) AS again FROM s WHERE label = 0 AND split = 'val' AND image_score IS NOT NULL AND NOT isnan(image_score) AND NOT isinf(image_score) GROUP BY run_id)
          SELECT run_id, round(threshold, 6) AS threshold, coalesce(n, 0) AS n_scores, round(again, 6) AS again, abs(threshold - again) <= greatest(1e-10 * greatest(abs(threshold), abs(again)), 1e-12) AS close FROM t LEFT JOIN q USING (run_id)""",
        "evidence_manifest": " UNION ALL ".join(_sum(n, c) for n, c in {
            "run_specs": ["run_id", "method", "category", "fold_id", "k", "seed", "variant", "config_sha256"], "dataset_records": ["record_id", "dataset", "category", "sample_id", "split", "label"],
            "scores": ["score_id", "run_id", "sample_id", "label"], "mask_scores": ["mask_row_id", "run_id", "sample_id", "refiner"], "artifact_files": ["file_id", "file_path", "size_bytes"]}.items()),
        "parse_options": "SELECT [true, false, true, NULL, NULL, false][event_id % 6 + 1] AS flag, ([0.25, 0.25, 0.5, NULL, 1.0]::DOUBLE[])[event_id % 5 + 1] AS fraction, count(*) AS n FROM events GROUP BY 1, 2",
        "matrix_report": "WITH b AS (SELECT DISTINCT run_id FROM (SELECT run_id, sample_id FROM scores GROUP BY ALL HAVING count(DISTINCT score_id) > 1)) SELECT method, count(*) AS n_runs, count(b.run_id) AS n_failed, count(b.run_id) = 0 AS ok FROM (SELECT DISTINCT run_id, method FROM run_specs) LEFT JOIN b USING (run_id) GROUP BY method",
        "resume_identity": """WITH a AS (SELECT run_id, min(config_sha256) AS x FROM run_specs GROUP BY run_id), b AS (SELECT run_id, min(CASE WHEN seed % 2 = 0 THEN 'other' ELSE config_sha256 END) AS y FROM run_specs WHERE k <> 2 GROUP BY run_id UNION ALL SELECT 'new_run', 'x')
          SELECT * FROM (SELECT run_id, CASE WHEN a.run_id IS NULL THEN 'added' WHEN b.run_id IS NULL THEN 'removed' WHEN x IS DISTINCT FROM y THEN 'changed' END AS change FROM a FULL JOIN b USING (run_id)) WHERE change IS NOT NULL""",
        "one_sided_runs": "SELECT DISTINCT run_id, 'left' AS side FROM scores ANTI JOIN mask_scores USING (run_id) UNION ALL SELECT DISTINCT run_id, 'right' FROM mask_scores ANTI JOIN scores USING (run_id)",
        "grid_gaps": """WITH r AS (SELECT DISTINCT run_id, method, category, k, seed FROM run_specs WHERE run_id IN (SELECT run_id FROM mask_scores)), g AS (SELECT * FROM (SELECT DISTINCT method FROM r), (SELECT DISTINCT category FROM r), (SELECT DISTINCT k FROM r), (SELECT DISTINCT seed FROM r))
          SELECT method, category, k, seed, 'missing' AS violation FROM g ANTI JOIN r USING (method, category, k, seed) UNION ALL SELECT method, category, k, seed, 'duplicate' FROM r GROUP BY ALL HAVING count(*) > 1""",
    }


ORACLE = _oracle()
