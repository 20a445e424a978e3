"""Run matrices, dependency graphs, and integrity checks that return what violates a rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.operators.metrics import exact_quantiles, finite
from wafergrid.session import written

#: Which method's results a method needs, of the same category, fold, shots and seed.
NEEDS = {
    "dinov2_single_sam2": ("dinov2_single",),
    "dinov2_multi_sam2": ("dinov2_multi",),
    "anomaly_consistent_sam2": ("dinov2_multi", "dinov2_multi_sam2"),
}


def run_id(method: Column, category: Column, fold: Column, k: Column, seed: Column, variant: Column | None = None) -> Column:
    """``method__category__foldF__kK__seedS``, with ``__variant`` unless it is 'primary' or missing."""
    base = F.concat(method, F.lit("__"), category, F.lit("__fold"), fold.cast("string"), F.lit("__k"), k.cast("string"), F.lit("__seed"), seed.cast("string"))
    return base if variant is None else F.concat(base, F.when(F.coalesce(variant, F.lit("primary")) == "primary", "").otherwise(F.concat(F.lit("__"), variant)))


def run_matrix(spark: SparkSession, methods: Sequence[str], categories: Sequence[str], shots: Sequence[int], seeds: Sequence[int], fold: int = 0) -> DataFrame:
    """(run_id, method, category, fold_id, k, seed): every combination; 'sam2_only' needs no support and has one run a category, with k and seed 0."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, methods))).alias("method")).withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    one = one.withColumn("k", F.explode(F.array(*map(F.lit, shots)))).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    alone = F.col("method") == "sam2_only"
    one = one.withColumn("k", F.when(alone, 0).otherwise(F.col("k"))).withColumn("seed", F.when(alone, 0).otherwise(F.col("seed"))).withColumn("fold_id", F.lit(fold)).distinct()
    return one.select(run_id(F.col("method"), F.col("category"), F.col("fold_id"), F.col("k"), F.col("seed")).alias("run_id"), "method", "category", "fold_id", "k", "seed")


def ablation_matrix(spark: SparkSession, ablations: Mapping[str, str], categories: Sequence[str], k: int, seed: int, fold: int = 0) -> DataFrame:
    """(run_id, method, category, variant): each named variant (name to method) in each category."""
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(m).alias("method")) for n, m in ablations.items()])
    a = spark.range(1).select(F.explode(rows).alias("a")).select("a.*").withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    return a.select(run_id(F.col("method"), F.col("category"), F.lit(fold), F.lit(k), F.lit(seed), F.col("variant")).alias("run_id"), "method", "category", "variant")


def filtered_runs(runs: DataFrame, *, run_id: str | None = None, method: str | None = None, category: str | None = None) -> DataFrame:
    """The runs of a matrix that fit all filters given; ValueError if none does."""
    for name, value in (("run_id", run_id), ("method", method), ("category", category)):
        runs = runs if value is None else runs.where(F.col(name) == value)
    if not runs.limit(1).count():
        raise ValueError("the filters select no run")
    return runs


def matrix_ok(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """(method, n_runs, n_failed, ok): by method, how many runs of a matrix have a failure. ``failures``: run_id, any number of rows a run."""
    bad = failures.select("run_id").distinct().withColumn("__bad", F.lit(1))
    g = runs.select("run_id", "method").distinct().join(bad, "run_id", "left").groupBy("method").agg(F.count("*").alias("n_runs"), F.count("__bad").alias("n_failed"))
    return g.withColumn("ok", F.col("n_failed") == 0)


def dependency_edges(runs: DataFrame) -> DataFrame:
    """(run_id, needs): the runs whose results a run reads, by the rules of ``NEEDS``. ``runs``: run_id, method, category, fold_id, k, seed."""
    rules = F.create_map(*[x for m, ns in NEEDS.items() for x in (F.lit(m), F.array(*map(F.lit, ns)))])
    r = runs.withColumn("__need", F.explode(F.element_at(rules, F.col("method"))))
    return r.select("run_id", run_id(F.col("__need"), F.col("category"), F.col("fold_id"), F.col("k"), F.col("seed")).alias("needs"))


def closure(edges: DataFrame, start: str = "run_id", end: str = "needs") -> DataFrame:
    """(start, end, depth): every run that a run needs directly or not, with the longest way to it. A cycle raises ValueError naming a run on it.

    Ways grow by one edge a round, each round's table written, until none grows; more rounds than nodes mean a cycle.
    """
    e = written(edges.select(F.col(start).alias("a"), F.col(end).alias("b")).distinct(), "edges")
    nodes = e.select("a").unionByName(e.select(F.col("b").alias("a"))).distinct().count()
    paths, front, depth = e.withColumn("depth", F.lit(1)), e, 1
    done = [paths]
    while True:
        front = written(front.toDF("a", "m").join(e.toDF("m", "b"), "m").select("a", "b").distinct(), "front")
        depth += 1
        if not front.limit(1).count():
            break
        round_trip = front.where("a = b").limit(1).collect()
        if round_trip or depth > nodes:
            raise ValueError(f"dependency cycle at {round_trip[0]['a'] if round_trip else front.first()['a']}")
        done.append(front.withColumn("depth", F.lit(depth)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("a", "b").agg(F.max("depth").alias("depth")).toDF(start, end, "depth")


def order_by_dependency(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, level): 0 for runs that need none, else one more than the highest level they need; by level and run_id it is a stable order to run in."""
    longest = closure(edges).groupBy("run_id").agg(F.max("depth").alias("level"))
    return runs.select("run_id").distinct().join(longest, "run_id", "left").select("run_id", F.coalesce("level", F.lit(0)).alias("level"))


def missing_dependencies(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose end is no run."""
    return edges.join(runs.select(F.col("run_id").alias("needs")), "needs", "left_anti")


def grid_violations(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dims..., violation): combinations of the values met that occur more than once ('duplicate') or never ('missing')."""
    n = df.groupBy(*dims).agg(F.count("*").alias("__n"))
    sets = df.agg(*[F.collect_set(d).alias(d) for d in dims])  # of the values of each dimension
    for d in dims:
        sets = sets.withColumn(d, F.explode(d))
    none = sets.join(n, list(dims), "left_anti").select(*dims, F.lit("missing").alias("violation"))
    return n.where("__n > 1").select(*dims, F.lit("duplicate").alias("violation")).unionByName(none)


def differing_fields(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key..., field, left, right) where rows of the same key differ (NULL equals NULL)."""
    a = left.select(*key, *[F.col(f).cast("string").alias(f"__a_{f}") for f in fields])
    b = right.select(*key, *[F.col(f).cast("string").alias(f"__b_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__a_{f}").alias("left"), F.col(f"__b_{f}").alias("right")) for f in fields])
    return a.join(b, list(key)).select(*key, F.explode(pairs).alias("p")).where("not (p.left <=> p.right)").select(*key, "p.field", "p.left", "p.right")


def close_to(a: Column, b: Column, relative: float = 1e-10, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def reconciled(df: DataFrame, key: Sequence[str], pairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(key..., measure, reported, again): measures whose reported value isn't close to the one worked out again (see ``close_to``). Both NULL, or both the same infinity, agree."""
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), a.cast("double").alias("reported"), b.cast("double").alias("again")) for n, (a, b) in pairs.items()])
    r = df.select(*key, F.explode(rows).alias("m")).select(*key, "m.*")
    both = finite(F.col("reported")) & finite(F.col("again"))
    same = F.col("reported").eqNullSafe(F.col("again")) | F.coalesce(both & close_to(F.col("reported"), F.col("again")), F.lit(False))
    return r.where(~same)


def unmet_dependencies(runs: DataFrame, edges: DataFrame, identity_: str) -> DataFrame:
    """(run_id, needs, depth, problem): of all runs that a run needs, directly or not, those that aren't there ('missing'), have no identity ('unnamed') or several ('ambiguous').

    ``runs``: run_id and ``identity_``, any number of rows a run; ``edges``: run_id, needs.
    """
    known = runs.groupBy(F.col("run_id").alias("needs")).agg(F.count_distinct(identity_).alias("__n"))
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") == 0, "unnamed").when(F.col("__n") > 1, "ambiguous")
    return closure(edges).join(known, "needs", "left").select("run_id", "needs", "depth", problem.alias("problem")).where("problem is not null")


def referenced_artifacts(references: DataFrame, files: DataFrame, content: str) -> DataFrame:
    """(place, n_references, n_files, n_contents, problem, sha256): each place referred to, with the hash of what is stored there.

    ``references``: place (NULL for a path that leads out of the store); ``files``: place, file_id and ``content``. Problems:
    'outside', 'missing', 'several' (listings of different contents); NULL without one.
    """
    asked = references.groupBy("place").agg(F.count("*").alias("n_references"))
    stored = files.groupBy("place").agg(F.count_distinct("file_id").alias("n_files"), F.count_distinct(content).alias("n_contents"), F.sha2(F.min(content), 256).alias("__sha"))
    j = asked.join(stored, "place", "left").na.fill(0, ["n_files", "n_contents"])
    problem = F.when(F.col("place").isNull(), "outside").when(F.col("n_files") == 0, "missing").when(F.col("n_contents") > 1, "several")
    return j.select("place", "n_references", "n_files", "n_contents", problem.alias("problem"), F.when(F.col("n_contents") == 1, F.col("__sha")).alias("sha256"))


def not_constant(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(by..., n_identities): groups whose rows don't all have the same ``fields``."""
    return df.groupBy(*by).agg(F.count_distinct(F.to_json(F.struct(*fields))).alias("n_identities")).where("n_identities > 1")


#: The first class whose part of a message occurs is that of the failure.
FAILURES = (
    ("missing", ("missing", "no such", "directory must be real")), ("failed", ("failed", "not complete")), ("duplicate", ("duplicate",)), ("dependency", ("dependency", "ancestor")),
    ("stale", ("stale", "identity", "checksum")), ("semantic", ("manifest row set", "metric", "evidence class")),
)


def failure_class(message: Column) -> Column:
    text = F.lower(message)
    out = F.lit("artifact")
    for name, parts in reversed(FAILURES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(text, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


def identity(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of a JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def table_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, checksum): of the bag of rows, whatever their order: the sum of the first 48 bits of each row's MD5. The columns are text, or turned to it, and parted by a unit separator; NULL is a record separator."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns])
    number = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("checksum"))


def evidence_manifest(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(name, n_rows, checksum) of each relation (see ``table_checksum``): two states of the evidence are the same if their manifests are."""
    return reduce(DataFrame.unionByName, [table_checksum(df, columns).select(F.lit(n).alias("name"), "n_rows", "checksum") for n, (df, columns) in tables.items()])


def changed_identities(before: DataFrame, after: DataFrame, key: str, identity_: str) -> DataFrame:
    """(key, change): what can't be resumed: keys whose identity is 'changed', 'added' or 'removed'. NULL identities are equal to each other only."""
    a, b = before.select(key, F.col(identity_).alias("__a"), F.lit(True).alias("__x")), after.select(key, F.col(identity_).alias("__b"), F.lit(True).alias("__y"))
    change = F.when(F.col("__x").isNull(), "added").when(F.col("__y").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def recalibrated(thresholds: DataFrame, scores: DataFrame, by: Sequence[str], threshold: str, score: str, quantile: float) -> DataFrame:
    """(by..., threshold, n_scores, again, close): stored thresholds beside those worked out again from the scores of their group; without scores ``close`` is NULL."""
    again = exact_quantiles(scores, by, score, [quantile]).select(*by, F.col("q0").alias("again"), F.col("n").alias("n_scores"))
    j = thresholds.select(*by, F.col(threshold).alias("threshold")).join(again, list(by), "left")
    return j.select(*by, "threshold", F.coalesce("n_scores", F.lit(0)).alias("n_scores"), "again", close_to(F.col("threshold"), F.col("again")).alias("close"))


def support_violations(support: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, violation): runs with another number of support samples than k ('count'), repeated ones ('repeated'), and ones that are no normal train rows of the run's category ('not_normal_train')."""
    n = support.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d"))
    j = runs.select("run_id", "k", "category").join(n, "run_id", "left").na.fill(0, ["n", "d"])
    good = manifest.where("split = 'train' and label = 0").select("category", "sample_id").distinct()
    bad = support.join(runs.select("run_id", "category"), "run_id").join(good, ["category", "sample_id"], "left_anti").select("run_id").distinct()
    return j.where("n <> k").select("run_id", F.lit("count").alias("violation")).unionByName(j.where("n <> d").select("run_id", F.lit("repeated").alias("violation"))).unionByName(bad.withColumn("violation", F.lit("not_normal_train")))
