"""Feature vectors: normalization, memory banks, nearest-neighbour scores, coresets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafergrid.operators.cumulative import join_groups, running_totals

#: A bank is broadcast up to so many bytes; a larger one is split into blocks that meet the queries in a shuffle.
BROADCAST_BYTES = 64 << 20
#: Vectors of a block or a piece take so many bytes.
PIECE_BYTES = 16 << 20
#: Vectors among which a local core is chosen.
CORE_ROWS = 4_096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column, eps: float = 1e-12) -> Column:
    """The vector divided by its length, or by ``eps`` if that is larger."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def memory_bank(vectors: DataFrame, vec: str, normalize: bool = True) -> DataFrame:
    """The vectors that aren't NULL, as a bank; normalized if so asked."""
    good = vectors.where(F.col(vec).isNotNull())
    return good.withColumn(vec, unit(F.col(vec))) if normalize else good


def nearest_distance_sql(queries: DataFrame, bank: DataFrame, key: str, by: Sequence[str], vec: str, most: int = 4_096) -> DataFrame:
    """(key, distance): Euclidean distance to the nearest bank vector of the same ``by``, in expressions alone.

    A bank is held as one list beside its queries, so no pairs become rows; one of more than ``most`` vectors fails when
    it is read. ``nearest_distance`` has no such limit.
    """
    held = bank.where(F.col(vec).isNotNull()).groupBy(*by).agg(F.collect_list(vec).alias("__bank"))
    small = F.when(F.size("__bank") <= most, F.col("__bank")).otherwise(F.raise_error(F.lit(f"a bank of more than {most} vectors")).cast(held.schema["__bank"].dataType))
    held = held.select(*by, small.alias("__bank"))
    square = lambda b: F.aggregate(F.zip_with(F.col(vec), b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    near = queries.join(held, list(by)).select(key, F.sqrt(F.array_min(F.transform("__bank", square))).alias("distance"))
    return near.groupBy(key).agg(F.min("distance").alias("distance"))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def nearest_distance(queries: DataFrame, bank: DataFrame, key: str, by: str, vec: str, *, normalize: bool = True, block: int = 4096) -> DataFrame:
    """(key, distance): Euclidean distance of each query vector to the nearest of the bank with the same ``by``.

    ``by`` is a whole number. Distances are worked out in blocks as matrix products. The bank is broadcast if its
    vectors take at most ``BROADCAST_BYTES``. Beyond that each bank is dealt into pieces and its queries into blocks,
    both of bounded size; each block meets each piece in a task of its own, and the least distance is kept. Vectors of
    a bank have one length; NULL vectors and queries without a bank have no row.
    """
    bank, queries = bank.where(F.col(vec).isNotNull()).select(by, vec), queries.where(F.col(vec).isNotNull()).select(key, by, vec)
    n, width = bank.agg(F.count("*"), F.coalesce(F.max(F.size(vec)), F.lit(0))).first()
    kind = queries.schema[key].dataType.simpleString()

    def distances(q: np.ndarray, b: np.ndarray) -> np.ndarray:
        if normalize:
            q, b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (q, b))
        bb, out = (b * b).sum(1), np.full(len(q), np.inf)
        for i in range(0, len(b), block):
            part = b[i : i + block]
            out = np.minimum(out, ((q * q).sum(1)[:, None] + bb[None, i : i + block] - 2 * q @ part.T).min(1))
        return np.sqrt(np.maximum(out, 0))

    if n * width * 8 <= BROADCAST_BYTES:
        held = bank.toArrow()  # its size was checked
        of, rows = held.column(0).to_numpy(), held.column(1)
        banks = {int(g): _rows(rows.take(pa.array(np.flatnonzero(of == g))).combine_chunks()) for g in np.unique(of)}  # widths differ between groups
        shared = queries.sparkSession.sparkContext.broadcast(banks)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups, keys, vecs = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0), batch.column(2)
                for g in np.unique(groups):
                    if g in shared.value:
                        at = pa.array(np.flatnonzero(groups == g))
                        yield pa.RecordBatch.from_pydict({key: keys.take(at), "distance": distances(_rows(vecs.take(at)), shared.value[g])})

        return queries.mapInArrow(score, f"{key} {kind}, distance double")

    rows_a_piece = max(1, PIECE_BYTES // (8 * width))
    dealt = lambda df, name: df.groupBy(F.col(by).alias("__g")).agg(F.ceil(F.count("*") / rows_a_piece).alias(name))
    grid = dealt(bank, "pieces").join(dealt(queries, "blocks"), "__g")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # other names, since both sides may come of one table
    b = bank.select(F.col(by).alias("__g"), F.col(vec).alias("__b")).join(grid, "__g").select("__g", F.pmod(F.xxhash64("__b"), F.col("pieces")).alias("piece"), every("blocks").alias("block"), "__b")
    q = queries.select(F.col(by).alias("__g"), F.col(key).alias("__k"), F.col(vec).alias("__q")).join(grid, "__g").select("__g", F.pmod(F.xxhash64("__k"), F.col("blocks")).alias("block"), every("pieces").alias("piece"), "__k", "__q")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"k": left.column("__k").slice(0, 0), "distance": pa.array(np.zeros(0))})
        return pa.table({"k": left.column("__k"), "distance": distances(*(_rows(c.combine_chunks()) for c in (left.column("__q"), right.column("__b"))))})

    cell = ["__g", "block", "piece"]
    met = q.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(meet, f"k {kind}, distance double")
    return met.groupBy(F.col("k").alias(key)).agg(F.min("distance").alias("distance"))


def gaussian_projection(width: int, out: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, out)).astype(np.float32)


def project(vectors: DataFrame, key: str, vec: str, out: int, seed: int) -> DataFrame:
    """(key, vec): each vector times a fixed random Gaussian matrix, divided by the root of ``out``."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1)).astype(np.float32)
                y = x @ gaussian_projection(x.shape[1], out, seed) / np.float32(np.sqrt(out))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * out, pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, vec])

    return vectors.where(F.col(vec).isNotNull()).select(key, vec).mapInArrow(run, f"{key} {kind}, {vec} array<float>")


def farthest_first(x: np.ndarray, most: int) -> tuple[list[int], list[float]]:
    """Row numbers from the first row on, each the one farthest from those before it, and those distances (infinite for the first). Rows equal to one before them are passed over."""
    square = np.einsum("ij,ij->i", x, x)
    order, reach = [0], [float("inf")]
    gap = square + square[0] - 2 * (x @ x[0])
    scale = 1e-6 * max(float(square.max()), 1e-30)
    for _ in range(1, most):
        at = int(gap.argmax())
        if gap[at] <= scale:
            break
        order.append(at)
        reach.append(float(np.sqrt(gap[at])))
        gap = np.minimum(gap, square + square[at] - 2 * (x @ x[at]))
    return order, reach


def greedy_coreset(vectors: DataFrame, by: str, key: str, vec: str, *, ratio: float = 0.01, seed: int = 4880, projection: int = 64) -> DataFrame:
    """(by, key, place): of each bank at most the fraction ``ratio`` of its vectors, at least one, that lie far apart.

    Local cores, then a merge: a bank is dealt by the hash of the keys into parts of about ``CORE_ROWS``; each part puts
    its vectors, after a random projection, in farthest-first order and offers twice its share with the distance at
    which each was chosen; of all offers of the bank those of the largest distances stay. So every place that is far
    from the rest of its part has a vector, a bank of any size is many tasks, and the choice depends on the seed and the
    keys only. Equal vectors of a part are offered once, so a bank of copies may have fewer. NULL vectors take no part.
    """
    if not 0 < ratio <= 1 or projection < 1:
        raise ValueError("ratio lies above 0 and at most at 1, projection is positive")
    good = vectors.where(F.col(vec).isNotNull()).select(F.col(by).alias("__g"), F.col(key).alias("__k"), F.col(vec).alias("__v"))
    sizes = good.groupBy("__g").agg(F.count("*").alias("__n"), F.ceil(F.count("*") / CORE_ROWS).alias("__parts"))
    dealt = join_groups(good, sizes, ["__g"]).withColumn("__part", F.pmod(F.xxhash64(F.lit(seed), "__k"), F.col("__parts")))
    kinds = {c: good.schema[c].dataType.simpleString() for c in ("__g", "__k")}

    def offered(part: pa.Table) -> pa.Table:
        part = part.sort_by("__k")
        x = _rows(part.column("__v").combine_chunks())
        start = int(np.random.default_rng([seed, len(x)]).integers(len(x)))
        y = np.roll(x @ gaussian_projection(x.shape[1], projection, seed).astype(np.float64), -start, axis=0)
        order, reach = farthest_first(y, min(len(x), int(np.ceil(2 * ratio * len(x))) + 1))
        chosen = part.take(pa.array((np.array(order) + start) % len(x)))
        return pa.table({"__g": chosen.column("__g"), "__k": chosen.column("__k"), "__n": chosen.column("__n"), "reach": pa.array(reach)})

    offers = dealt.groupBy("__g", "__part").applyInArrow(offered, f"__g {kinds['__g']}, __k {kinds['__k']}, __n long, reach double")
    # a place is a running count, in ranges: a bank's offers are no single task
    placed = running_totals(offers.withColumn("far", -F.col("reach")).withColumn("place", F.lit(1)), ["__g"], ["far", "__k"], ["place"])
    kept = placed.where(F.col("place_upto") <= F.greatest(F.lit(1), F.round(F.col("__n") * ratio)))
    return kept.select(F.col("__g").alias(by), F.col("__k").alias(key), F.col("place_upto").cast("long").alias("place"))
