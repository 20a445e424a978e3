"""Aggregation of run results and paired statistics with bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replicates drawn at a time. The draws come in this order from one generator, so it belongs to the result.
BATCH = 256
#: So many numbers are drawn into memory at once.
PIECE = 1 << 22
#: So many where draws are counted: the counts of a piece stay in the CPU's cache.
COUNTED = 1 << 18


def macro_by_seed(df: DataFrame, by: Sequence[str], category: str, seed: str, value: str) -> DataFrame:
    """(by..., category, n_seeds, mean, seed_std): per category over seeds, and 'macro': of each seed the mean over categories, then mean and deviation over seeds (0 for one seed)."""
    spread = F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("seed_std")
    own = df.groupBy(*by, category).agg(F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), spread)
    per_seed = df.groupBy(*by, seed).agg(F.avg(value).alias(value))
    macro = per_seed.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), spread).withColumn(category, F.lit("macro"))
    return own.unionByName(macro)


def checked_grid(df: DataFrame, by: Sequence[str], category: str, seed: str) -> DataFrame:
    """``df`` itself; ValueError if a group of ``by`` has a category and seed twice, or categories of different seeds."""
    cells = df.groupBy(*by, category, seed).agg(F.count("*").alias("__n"))
    sizes = cells.groupBy(*by).agg(F.max("__n").alias("most"), F.count("*").alias("cells"), F.count_distinct(category).alias("categories"), F.count_distinct(seed).alias("seeds"))
    bad = sizes.where("most > 1 or cells <> categories * seeds").limit(1).collect()
    if bad:
        what = "a cell more than once" if bad[0]["most"] > 1 else "categories that don't have the same seeds"
        raise ValueError(f"{ {b: bad[0][b] for b in by} } has {what}")
    return df


def macro_with_intervals(df: DataFrame, by: Sequence[str], category: str, seed: str, value: str, *, confidence: float = 0.95, samples: int = 2000, random_seed: int = 4880) -> DataFrame:
    """(by..., category, n_categories, n_seeds, mean, seed_std, ci_low, ci_high, aggregation): as ``macro_by_seed``, with intervals of the means over seeds.

    The grid is checked first (see ``checked_grid``). A bootstrap is over the seeds of one group, which are few.
    """
    rows = checked_grid(df, by, category, seed).select(*by, F.col(category).alias("category"), F.col(seed).alias("seed"), F.col(value).cast("double").alias("v"))
    macro = rows.groupBy(*by, "seed").agg(F.avg("v").alias("v"), F.count("*").alias("n_categories")).withColumn("category", F.lit("macro"))
    both = rows.withColumn("n_categories", F.lit(1).cast("long")).withColumn("aggregation", F.lit("within_category")).unionByName(macro.withColumn("aggregation", F.lit("category_macro")))
    keys = [*by, "category", "n_categories", "aggregation"]
    spread = both.groupBy(*keys).agg(F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("seed_std"))
    found = bootstrap_ci(both, keys, ["seed"], "v", confidence=confidence, samples=samples, seed=random_seed).withColumnRenamed("n", "n_seeds").join(spread, keys)
    return found.select(*by, F.col("category").alias(category), "n_categories", "n_seeds", "mean", "seed_std", "ci_low", "ci_high", "aggregation")


def unpivoted(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(ids..., metric, value): one row a metric; NULL and NaN are left out."""
    good = [F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m) for m in metrics]
    return df.select(*ids, *good).unpivot(list(ids), list(metrics), "metric", "value").where("value is not null")


def all_metrics_macro(df: DataFrame, by: Sequence[str], category: str, seed: str, metrics: Sequence[str]) -> DataFrame:
    """As ``macro_by_seed`` for each metric, with ``scope``: deviations of a single seed are NULL and it is called descriptive."""
    out = macro_by_seed(unpivoted(df, [*by, category, seed], metrics), [*by, "metric"], category, seed, "value")
    one = F.col("n_seeds") == 1
    return out.withColumn("seed_std", F.when(~one, F.col("seed_std"))).withColumn("scope", F.when(one, "descriptive_single_seed").otherwise("support_seeds"))


def ablation_rows(df: DataFrame, by: Sequence[str], category: str, metrics: Sequence[str]) -> DataFrame:
    """(by..., metric, category, value): category values and their mean as 'macro', without intervals."""
    long = unpivoted(df, [*by, category], metrics)
    macro = long.groupBy(*by, "metric").agg(F.avg("value").alias("value")).withColumn(category, F.lit("macro"))
    return long.unionByName(macro)


def with_mean_row(df: DataFrame, name: str, counts: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``df`` and a row named 'mean': sums of the counts, and means of the metrics without NULL and NaN."""
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    mean = df.agg(*[F.sum(c).cast("long").alias(c) for c in counts], *[F.avg(clean(c)).alias(c) for c in metrics]).withColumn(name, F.lit("mean"))
    return df.select(name, *[F.col(c).cast("long").alias(c) for c in counts], *metrics).unionByName(mean)


def with_group_means(df: DataFrame, group: str, name: str, metrics: Sequence[str]) -> DataFrame:
    """``df`` and for each group a row named 'mean' with the means of the metrics without NULL and NaN."""
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.select(group, name, *metrics).unionByName(df.groupBy(group).agg(*[F.avg(clean(c)).alias(c) for c in metrics]).withColumn(name, F.lit("mean")))


def breakdown(df: DataFrame, delta: Column, dims: Sequence[str]) -> DataFrame:
    """(scope, level, n, mean_delta): over all rows and by each of ``dims``, in one pass of grouping sets."""
    rows = df.select(*[F.col(d).cast("string").alias(d) for d in dims], delta.alias("__d"))
    sets = [[], *[[F.col(d)] for d in dims]]
    g = rows.groupingSets(sets, *dims).agg(F.count("*").alias("n"), F.avg("__d").alias("mean_delta"), F.grouping_id().alias("__g"))
    n, scope, level = len(dims), F.lit("overall"), F.lit("all")
    for i, d in enumerate(dims):
        here = F.col("__g") == ((1 << n) - 1) ^ (1 << (n - 1 - i))
        scope, level = F.when(here, d).otherwise(scope), F.when(here, F.col(d)).otherwise(level)
    return g.select(scope.alias("scope"), level.alias("level"), "n", "mean_delta")


def _interval(means: np.ndarray, confidence: float) -> tuple[float, float]:
    tail = 50 * (1 - confidence)
    low, high = np.percentile(means, [tail, 100 - tail])
    return float(low), float(high)


def _checked(confidence: float, samples: int) -> None:
    if not 0 < confidence < 1 or samples < 1:
        raise ValueError("confidence lies between 0 and 1, samples is positive")


def bootstrap_mean(values: np.ndarray, confidence: float = 0.95, samples: int = 2000, seed: int = 4880) -> tuple[float, float, float]:
    """Mean and percentile interval of means of samples drawn with replacement."""
    _checked(confidence, samples)
    values, rng = np.asarray(values, dtype=np.float64), np.random.default_rng(seed)
    if not values.size or not np.isfinite(values).all():
        raise ValueError("values must be finite, and at least one")
    drawn = [values[part].mean(axis=1) for a in range(0, samples, BATCH) for part in _draws(rng, values.size, min(BATCH, samples - a))]
    return float(values.mean()), *_interval(np.concatenate(drawn), confidence)


def _draws(rng: np.random.Generator, n: int, batch: int, piece: int | None = None) -> Iterator[np.ndarray]:
    """``batch`` rows of ``n`` numbers below ``n``, in pieces of bounded size (``PIECE``, unless given): the generator gives the same numbers as for all rows at once."""
    rows = max(1, (piece or PIECE) // n)
    for a in range(0, batch, rows):
        yield rng.integers(0, n, size=(min(rows, batch - a), n))


def bootstrap_ci(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, confidence: float = 0.95, samples: int = 2000, seed: int = 4880) -> DataFrame:
    """(by..., n, mean, ci_low, ci_high) of each group; ``order`` fixes the order in which values are drawn from. NULL and NaN are left out; a group is one task."""
    _checked(confidence, samples)
    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    good = df.where(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).isNotNull())

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(list(order), kind="stable")[value].to_numpy(float)
        return pd.DataFrame([(*key, len(v), *bootstrap_mean(v, confidence, samples, seed))], columns=[*by, "n", "mean", "ci_low", "ci_high"])

    return good.groupBy(*by).applyInPandas(one, f"{kinds}, n long, mean double, ci_low double, ci_high double")


def paired_bootstrap(df: DataFrame, by: Sequence[str], order: Sequence[str], baseline: str, candidate: str, **options) -> DataFrame:
    """As ``bootstrap_ci`` of candidate minus baseline."""
    return bootstrap_ci(df.withColumn("__delta", F.col(candidate) - F.col(baseline)), by, order, "__delta", **options)


def unbalanced_cells(df: DataFrame, category: str, shot: str, seed: str, sample: str) -> DataFrame:
    """Violations of a complete grid: cells met more than once ('duplicate'), samples of a category without a cell of each shot and seed ('incomplete')."""
    cells = df.groupBy(category, shot, seed, sample).agg(F.count("*").alias("n"))
    twice = cells.where("n > 1").select(F.col(category), F.col(sample), F.lit("duplicate").alias("violation"))
    want = df.agg(F.count_distinct(F.struct(shot, seed))).first()[0]
    short = cells.groupBy(category, sample).agg(F.count("*").alias("m")).where(F.col("m") < want).select(category, sample, F.lit("incomplete").alias("violation"))
    return twice.unionByName(short)


def clustered_bootstrap(df: DataFrame, by: Sequence[str], *, category: str, shot: str, seed: str, sample: str, baseline: str, candidate: str, confidence: float = 0.95, samples: int = 2000, random_seed: int = 4880) -> DataFrame:
    """(by..., mean_delta, ci_low, ci_high, seed_std, n_rows, n_images) of repeated measures on a complete grid.

    Every (category, shot) counts the same. A replicate draws support seeds once for all of them, and images once a
    category, shared by shots and seeds. An incomplete or repeated grid raises ValueError, and so does a cell with a NULL. A
    comparison is one task: it holds, of each image, one sum a seed over the shots, which is all that the replicates need. Its
    rows come in batches, of which nothing else is kept.
    """
    found = _clustered(df, by, {}, {"": (baseline, candidate)}, category, shot, seed, sample, confidence, samples, random_seed)
    return found.select(*by, *_MEASURES)


_MEASURES = {"mean_delta": "double", "ci_low": "double", "ci_high": "double", "seed_std": "double", "n_rows": "long", "n_images": "long"}


def _places(cells: pa.StructArray, image: np.ndarray, level: np.ndarray, metrics: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Cells summed up by image and level, a row for each pair: the first cell of each, and its columns. A cell whose level is negative takes no part."""
    used = np.flatnonzero(level >= 0)
    used = used[np.lexsort((level[used], image[used]))]
    first = np.ones(len(used), bool)
    first[1:] = (np.diff(image[used]) != 0) | (np.diff(level[used]) != 0)
    row = np.cumsum(first) - 1

    codes = {c: pc.rank(cells.field(c), tiebreaker="dense").to_numpy()[used] for c in ("shot", "seed")}

    def distinct(c: str) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """An order of the cells by row and value; where in it each distinct value of a row begins; the lists of these values."""
        order = np.lexsort((codes[c], row))
        starts = np.flatnonzero(np.r_[np.ones(min(1, len(order)), bool), (np.diff(row[order]) != 0) | (np.diff(codes[c][order]) != 0)])
        ends = np.r_[0, np.cumsum(np.bincount(row[order][starts], minlength=int(first.sum())))]
        return order, starts, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells.field(c).take(pa.array(used[order[starts]])))

    shots, (order, starts, seeds) = distinct("shot")[2], distinct("seed")
    by_cell = np.lexsort((codes["seed"], codes["shot"], row))
    same = np.logical_and.reduce([np.diff(v[by_cell]) == 0 for v in (row, *codes.values())])
    twice = np.zeros(int(first.sum()), bool)
    twice[row[by_cell][1:][same]] = True
    sums = np.stack([np.add.reduceat(cells.field(f"d{m}").to_numpy()[used][order], starts) if len(starts) else np.zeros(0) for m in range(metrics)], 1)
    ends = pa.array(seeds.offsets.to_numpy() * metrics, pa.int32())
    return used[first], {"n": pa.array(np.bincount(row, minlength=int(first.sum())), pa.int64()), "twice": pa.array(twice), "shots": shots, "seeds": seeds, "sums": pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))}


def _clustered(df: DataFrame, by: Sequence[str], scopes: Mapping[str, Column], metrics: Mapping[str, tuple[str, str]], category: str, shot: str, seed: str, sample: str, confidence: float, samples: int, random_seed: int) -> DataFrame:
    """(by..., metric, scope, level, measures...): ``clustered_bootstrap`` of each metric over all rows ('overall', 'all') and each level of each scope.

    The cells of an image are gathered first, and summed up over shots for each level that they have: only these sums go to
    the comparisons. All metrics of a level are drawn together, as they have the same grid.
    """
    _checked(confidence, samples)
    of = {"category": category, "image": sample, "shot": shot, "seed": seed}
    kinds = {c: df.schema[name].dataType.simpleString() for c, name in of.items()}
    keys = [f"__b{i}" for i in range(len(by))]
    key_kinds = [df.schema[b].dataType.simpleString() for b in by]
    named = [F.coalesce(F.col(name), F.raise_error(f"a cell without {name}").cast(kinds[c])).alias(c) for c, name in of.items()]
    levels = [c.cast("string").alias(f"l{i}") for i, c in enumerate(scopes.values())]
    deltas = [F.col(y).cast("double") - F.col(x).cast("double") for x, y in metrics.values()]
    deltas = [F.nanvl(d, F.lit(None).cast("double")) for d in deltas]
    deltas = [F.coalesce(d, F.raise_error("the grid of a category isn't complete: a cell without a value").cast("double")).alias(f"d{i}") for i, d in enumerate(deltas)]
    cells = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *named, *levels, *deltas)
    rest = [c for c in cells.columns if c not in {*keys, "category", "image"}]
    gathered = cells.groupBy(*keys, "category", "image").agg(F.collect_list(F.struct(*rest)).alias("cells"))
    own = [*zip(keys, key_kinds), ("category", kinds["category"]), ("image", kinds["image"])]
    schema = ", ".join(f"{n} {k}" for n, k in [*own, ("scope", "string"), ("level", "string"), ("n", "long"), ("twice", "boolean"), ("shots", f"array<{kinds['shot']}>"), ("seeds", f"array<{kinds['seed']}>"), ("sums", "array<double>")])
    names, count = list(scopes), len(metrics)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            flat, image = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for i, scope in enumerate(["overall", *names]):
                if i:
                    told = flat.field(f"l{i - 1}").dictionary_encode()
                    level, words = pc.fill_null(told.indices, -1).to_numpy(zero_copy_only=False), told.dictionary
                else:
                    level, words = np.zeros(len(flat), np.int32), pa.array(["all"])
                at, columns = _places(flat, image, level, count)
                kept = batch.select([n for n, _ in own]).take(pa.array(image[at]))
                columns = {"scope": pa.array([scope] * len(at), pa.string()), "level": words.take(pa.array(level[at])), **columns}
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns.values()], names=[*kept.schema.names, *columns])

    def one(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shots, n_rows = _image_sums(batches, count)
        means, strata, a_seed = _replicates(sums, shots, samples, random_seed)
        rows = []
        for m, name in enumerate(metrics):
            std = float(a_seed[:, m].std(ddof=1)) if len(a_seed) > 1 else 0.0
            rows.append((*(k.as_py() for k in key), name, float(strata[m]), *_interval(means[:, m], confidence), std, n_rows, sum(map(len, sums))))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), [*(k.type for k in key), pa.string(), *[pa.float64()] * 4, pa.int64(), pa.int64()])], names=[*keys, "scope", "level", "metric", *_MEASURES])

    out = ", ".join(f"{n} {k}" for n, k in [*zip(keys, key_kinds), ("scope", "string"), ("level", "string"), ("metric", "string"), *_MEASURES.items()])
    found = gathered.mapInArrow(placed, schema).groupBy(*keys, "scope", "level").applyInArrow(one, out)
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "metric", "scope", "level", *_MEASURES)


def _image_sums(batches: Iterator[pa.RecordBatch], metrics: int) -> tuple[list[np.ndarray], int, int]:
    """Rows of a comparison: of each category, in order, the sums by image, seed and metric; how many shots and cells there are. A batch is copied from and let go."""
    categories, images, parts, n_rows, whole = [], [], [], 0, True
    values, sizes = {"shots": None, "seeds": None}, {"shots": set(), "seeds": set()}
    for batch in batches:
        if pc.any(batch.column("twice")).as_py():
            raise ValueError("a cell is met more than once")
        cells = 1
        for c, known in values.items():
            lists = batch.column(c)
            values[c] = pc.unique(pa.concat_arrays([lists.flatten(), *([] if known is None else [known])]))
            size = pc.list_value_length(lists).to_numpy()
            sizes[c].update(np.unique(size).tolist())
            cells = cells * size
        whole &= bool((batch.column("n").to_numpy() == cells).all())
        n_rows += pc.sum(batch.column("n")).as_py()
        every = pa.array(np.arange(batch.num_rows))
        categories.append(batch.column("category").take(every).dictionary_encode())
        images.append(batch.column("image").take(every))
        parts.append(batch.column("sums").flatten().to_numpy().copy())
    if not whole or any(sizes[c] != {len(values[c])} for c in values):
        raise ValueError("the grid of a category isn't complete")
    seeds, told = len(values["seeds"]), pa.chunked_array(categories).unify_dictionaries()
    place = pc.rank(told.chunk(0).dictionary, tiebreaker="first").to_numpy()[np.concatenate([c.indices.to_numpy() for c in told.chunks])]
    order = pc.sort_indices(pa.table({"place": place, "image": pa.chunked_array(images)}), sort_keys=[("place", "ascending"), ("image", "ascending")]).to_numpy()
    to, end, out = np.empty_like(order), len(order), np.empty((len(order), seeds, metrics))
    to[order] = np.arange(end)
    while parts:
        part = parts.pop().reshape(-1, seeds, metrics)
        out[to[end - len(part) : end]], end = part, end - len(part)
    return np.split(out, np.flatnonzero(np.diff(place[order])) + 1), len(values["shots"]), n_rows


def _replicates(sums: Sequence[np.ndarray], shots: int, samples: int, random_seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each category the sums over shots, by image, seed and metric: means of the replicates by metric, mean by metric, means by seed and metric."""
    seeds, metrics = sums[0].shape[1:]
    flat = [c.reshape(len(c), -1) for c in sums]
    rng, means = np.random.default_rng(random_seed), []
    for a in range(0, samples, BATCH):
        b = min(BATCH, samples - a)
        drawn = rng.integers(0, seeds, size=(b, seeds))
        # the mean over drawn seeds and images equals that of weights: how often each was drawn
        ws, total = np.stack([(drawn == s).sum(1) for s in range(seeds)], 1) / seeds, np.zeros((b, metrics))
        for c in flat:
            at, n = 0, len(c)
            for images in _draws(rng, n, b, COUNTED):
                m = len(images)
                images += np.arange(m)[:, None] * n
                wi = np.bincount(images.ravel(), minlength=m * n).reshape(m, n).astype(float)
                total[at : at + m] += np.einsum("bs,bsm->bm", ws[at : at + m], (wi @ c / n).reshape(m, seeds, metrics))
                at += m
        means.append(total / (len(flat) * shots))
    a_seed = np.mean([c.mean(axis=0) for c in sums], axis=0) / shots
    return np.concatenate(means), a_seed.mean(axis=0), a_seed


def comparison_intervals(df: DataFrame, scopes: Mapping[str, Column], metrics: Mapping[str, tuple[str, str]], *, category: str, shot: str, seed: str, sample: str, confidence: float = 0.95, samples: int = 2000, random_seed: int = 4880) -> DataFrame:
    """(metric, scope, level, mean_delta, ci_low, ci_high, seed_std, n_rows, n_images): repeated-measures intervals of candidate minus baseline, over all rows and each level of each scope; rows whose level is NULL aren't in that scope.

    ``metrics``: name to the columns of baseline and candidate. All else as for ``clustered_bootstrap``.
    """
    return _clustered(df, [], scopes, metrics, category, shot, seed, sample, confidence, samples, random_seed)


def decision(f1_low: Column, f1_high: Column, iou_low: Column, iou_high: Column) -> Column:
    """'improves' if both intervals lie above 0, 'inferior' if both lie below, else 'mixed'."""
    return F.when((f1_low > 0) & (iou_low > 0), "improves").when((f1_high < 0) & (iou_high < 0), "inferior").otherwise("mixed")
