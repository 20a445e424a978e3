"""The k most similar vectors for each query vector, by cosine, from balanced posting lists.

Method: centroids are fitted on a bounded sample and split until balanced; every vector is put into the list of its
nearest centroid and, near a boundary, into further ones (replicas); a query finds its nearest centroids by a walk
over an in-memory graph of the centroids, and the ratio of distances decides how many lists it reads. Similarities
inside the lists are exact (float64), so only a neighbour that lies in no list read can be missed.

The centroids that are broadcast are bounded in number. Where their lists would be longer than wanted, each list has
centroids of its own, which are fitted on a sample of the list and never leave the executors: its vectors and the
queries that read it meet these by list, and the ratio of distances then decides among the leaves of all lists. So the
rows that a query reads don't grow with the length of the lists.

Equal vectors are collapsed: a list holds a vector once with its ``k + 1`` smallest ids, which is all that any answer
can hold of them, since equal similarities are ordered by id. A group of copies, however large, thus never travels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafergrid.session import written

#: A list expected to be longer than this is split into parts, by the hash of the vector.
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class ListParams:
    """``list_rows``: wanted length of a list. ``top_lists``: most centroids of a space that are broadcast (16,384 of 64
    floats are 4 MB); longer lists are divided into leaves. ``least_sample`` and ``per_list``: a space's centroids are fitted
    on a sample of about ``per_list`` vectors a list, at least ``least_sample`` and so at most ``top_lists * per_list``
    (262,144); those of a divided list on ``per_list`` a leaf.
    ``replicas`` and ``boundary``: a vector goes to its nearest lists, at most so many, whose distance is within
    ``1 + boundary`` of the nearest. ``probe_ratio``, ``probes``, ``probes_root``: a query reads the lists within
    ``1 + probe_ratio`` of its nearest centroid, at least ``probes`` and at least ``probes_root`` times the root of the number
    of lists, and at most four times as many."""

    list_rows: int = 1_000
    top_lists: int = 16_384
    least_sample: int = 24_000
    per_list: int = 16
    iterations: int = 8
    replicas: int = 3
    boundary: float = 0.05
    probe_ratio: float = 0.35
    probes: int = 12
    probes_root: float = 1.0
    seed: int = 4880

    def read(self, lists: float) -> tuple[int, int]:
        """How many of so many lists a query reads, at least and at most."""
        least = max(self.probes, math.ceil(self.probes_root * math.sqrt(lists)))
        return least, 4 * least


def usable(vector: Column, width: Column) -> Column:
    """Not null, of the space's width, finite throughout and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither over- nor underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def balanced_centroids(x: np.ndarray, lists: int, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of the unit rows ``x`` and their shares of the rows: Lloyd's steps, then clusters above twice the mean size are halved."""
    rng = np.random.default_rng(seed)
    x = np.unique(x.astype(np.float32), axis=0)
    lists = max(1, min(lists, len(x)))
    c = x[np.sort(rng.choice(len(x), lists, replace=False))]

    def nearest(rows, cent):
        return np.concatenate([(rows[i : i + 4096] @ cent.T).argmax(1) for i in range(0, len(rows), 4096)])

    def means(rows, at, old):
        order = np.argsort(at, kind="stable")
        some, starts = np.unique(at[order], return_index=True)
        total = np.zeros_like(old)
        total[some] = np.add.reduceat(rows[order], starts, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), old)

    for _ in range(iterations):
        c = means(x, nearest(x, c), c)
    done: list[np.ndarray] = []
    held: list[int] = []
    at, limit = nearest(x, c), 2 * max(1.0, len(x) / lists)
    open_ = [x[at == j] for j in range(len(c))]
    while open_:
        rows = open_.pop()
        if not len(rows):
            continue
        mid = rows.mean(0, keepdims=True)
        mid /= max(float(np.linalg.norm(mid)), 1e-9)
        if len(rows) <= limit:
            done.append(mid)
            held.append(len(rows))
            continue
        axis = rows @ (rows[(rows @ mid[0]).argmin()] - mid[0])
        order = np.argsort(axis, kind="stable")  # halves of the same size, towards the farthest row and away from it
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return np.concatenate(done).astype(np.float32), np.array(held) / len(x)


class CentroidGraph:
    """Each centroid linked with its nearest ones and a few random ones; searched by a best-first walk with a beam."""

    def __init__(self, c: np.ndarray, degree: int = 24, seed: int = 0) -> None:
        self.c, n = c, len(c)
        degree = min(degree, n - 1)
        near = [np.argpartition(-(c[i : i + 1024] @ c.T), degree, axis=1)[:, : degree + 1] for i in range(0, n, 1024)] if degree else [np.zeros((n, 1), int)]
        far = np.random.default_rng(seed).integers(0, n, (n, min(4, n)))
        self.links = np.concatenate([np.concatenate(near), far], axis=1)
        self.starts = np.unique(np.linspace(0, n - 1, min(n, 2 * math.isqrt(n) + 4)).astype(int))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of about the ``beam`` nearest centroids of each unit row of ``q``, nearest first. All rows walk together, four steps at a time; rows that have nothing left to open rest."""
        c, n, beam = self.c, len(self.c), min(beam, len(self.c))
        seen = np.zeros((len(q), n), bool)
        seen[:, self.starts] = True
        ids = np.tile(self.starts, (len(q), 1))
        sim = q @ c[self.starts].T
        if ids.shape[1] < beam:
            fill = ((0, 0), (0, beam - ids.shape[1]))
            ids, sim = np.pad(ids, fill), np.pad(sim, fill, constant_values=-np.inf)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        opened = np.isneginf(sim)
        while len(rows := np.flatnonzero(~opened.all(1))):
            some = ~opened[rows]
            some &= np.cumsum(some, axis=1) <= 4
            opened[rows] |= some
            at, place = np.nonzero(some)
            links = self.links[ids[rows[at], place]]
            key = np.unique((at[:, None] * n + links).ravel())  # sorted by row
            at, new = key // n, key % n
            fresh = ~seen[rows[at], new]
            at, new = at[fresh], new[fresh]
            seen[rows[at], new] = True
            count = np.bincount(at, minlength=len(rows))
            if not count.any():
                continue
            column = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more = np.zeros((len(rows), count.max()), ids.dtype), np.full((len(rows), count.max()), -np.inf, np.float32)
            more_ids[at, column], more[at, column] = new, np.einsum("ij,ij->i", q[rows[at]], c[new])
            all_ids, all_sim = np.concatenate([ids[rows], more_ids], axis=1), np.concatenate([sim[rows], more], axis=1)
            all_opened = np.concatenate([opened[rows], np.isneginf(more)], axis=1)
            order = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            ids[rows], sim[rows], opened[rows] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sim, all_opened))
        return ids, np.sqrt(np.maximum(0, 2 - 2 * sim))


@dataclass(frozen=True)
class Space:
    """Centroids of a space, the number of its first list, in how many parts each list is held, and into how many leaves it is divided."""

    centroids: np.ndarray
    first: int
    parts: np.ndarray
    leaves: np.ndarray


def fit_spaces(vectors: DataFrame, params: ListParams) -> dict[str, Space]:
    """Centroids of each space, fitted on a sample of bounded expected size (see ``ListParams``).

    ``vectors``: space STRING, id, vec ARRAY<FLOAT> (usable ones). The sample is by hash of the id: the same rows on
    each run. The number of centroids follows the number of rows, up to ``top_lists``.
    """
    counts = {r["space"]: r["n"] for r in vectors.groupBy("space").agg(F.count("*").alias("n")).collect()}  # one row a space
    if not counts:
        return {}
    lists = {s: min(params.top_lists, max(1, round(n / params.list_rows))) for s, n in counts.items()}
    rates = {s: max(params.least_sample, params.per_list * lists[s]) / n for s, n in counts.items()}
    rate = F.element_at(F.create_map(*[F.lit(y) for s, r in rates.items() for y in (s, float(r))]), F.col("space"))
    u = F.pmod(F.xxhash64(F.lit(params.seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.where(u < rate).select("space", "vec")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(pdf["vec"].to_numpy()))
        c, share = balanced_centroids(x, lists[key[0]], params.iterations, params.seed)
        return pd.DataFrame({"space": key[0], "c": [c.tobytes()], "share": [share.tobytes()]})

    fitted = sample.groupBy("space").applyInPandas(fit, "space string, c binary, share binary").collect()  # bounded by top_lists a space
    out, first = {}, 0
    for r in sorted(fitted, key=lambda r: r["space"]):
        share = np.frombuffer(bytes(r["share"]))
        own = share * counts[r["space"]]
        leaves = np.where(own > 3 * params.list_rows, np.ceil(own / params.list_rows), 1).astype(np.int64)
        parts = 1 + (own * params.replicas // BLOCK_ROWS).astype(np.int64)
        out[r["space"]] = Space(np.frombuffer(bytes(r["c"]), np.float32).reshape(len(share), -1), first, parts, leaves)
        first += len(share)
    return out


def _lists_of(x: np.ndarray, c: np.ndarray, replicas: int, boundary: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and list numbers: the nearest list of each unit row and those about as near."""
    rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    r = min(replicas, len(c))
    for i in range(0, len(x), 4096):
        sim = x[i : i + 4096].astype(np.float32) @ c.T
        top = np.argpartition(-sim, r - 1, axis=1)[:, :r]
        d = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sim, top, 1)))
        a, b = np.nonzero(d <= d.min(1, keepdims=True) * (1 + boundary) + 1e-6)
        rows.append(a + i)
        lists.append(top[a, b])
    return np.concatenate(rows), np.concatenate(lists)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of float32 as binary values."""
    width = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, width * len(x) + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x, dtype=np.float32))])


def _unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float32).reshape(len(column), -1)


def _part(x: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A number below ``parts`` for each row, by its contents."""
    odd = np.random.default_rng(0).integers(0, 1 << 63, x.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.ascontiguousarray(x, dtype=np.float32).view(np.uint32).astype(np.uint64)
    return (((bits * odd).sum(1) >> np.uint64(33)).astype(np.int64) % parts).astype(np.int32)


def posting_lists(vectors: DataFrame, spaces: dict[str, Space], k: int, params: ListParams) -> DataFrame:
    """(list, leaf, part, vec BINARY of float32, ids): each distinct vector of a batch in its lists with its k + 1 smallest ids. ``leaf`` is 0 where a list isn't divided, else NULL."""
    shared = vectors.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("space").to_pylist(), dtype=object)
            ids, vecs = batch.column("id").to_numpy(), batch.column("vec")
            for name, space in shared.value.items():
                at = np.flatnonzero(names == name)
                if not len(at):
                    continue
                x = np.ascontiguousarray(_matrix(vecs.take(pa.array(at))), dtype=np.float32)
                own = ids[at]
                _, index, which = np.unique(x.view(f"V{x.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
                order = np.lexsort((own, which))
                w, o = which[order], own[order]
                once = np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])]
                w, o = w[once], o[once]
                few = np.arange(len(w)) - np.searchsorted(w, w) <= k
                w, o = w[few], o[few]
                ends = np.searchsorted(w, np.arange(len(index) + 1)).astype(np.int32)
                lists_of_ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(o, pa.int64()))
                x = x[index]
                rows, lists = _lists_of(_unit(x), space.centroids, params.replicas, params.boundary)
                yield pa.RecordBatch.from_pydict({
                    "list": pa.array(lists + space.first, pa.int32()),
                    "leaf": pa.array(np.zeros(len(lists), np.int32), mask=space.leaves[lists] > 1),
                    "part": pa.array(_part(x[rows], space.parts[lists]), pa.int32()),
                    "vec": _packed(x[rows]),
                    "ids": lists_of_ids.take(pa.array(rows)),
                })

    return vectors.select("space", "id", "vec").mapInArrow(run, "list int, leaf int, part int, vec binary, ids array<long>")


def probes(queries: DataFrame, spaces: dict[str, Space], params: ListParams) -> DataFrame:
    """(list, leaf, query, qvec BINARY): the lists a query reads, by a walk over the centroid graph and distance ratios; ``leaf`` as in ``posting_lists``."""
    shared = queries.sparkSession.sparkContext.broadcast(spaces)
    schema = pa.schema([("list", pa.int32()), ("leaf", pa.int32()), ("query", pa.int64()), ("qvec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs: dict[str, CentroidGraph] = {}
        for batch in batches:
            names = np.array(batch.column("space").to_pylist(), dtype=object)
            for name, space in shared.value.items():
                mine = np.flatnonzero(names == name)
                if len(mine) and name not in graphs:
                    graphs[name] = CentroidGraph(space.centroids)
                least, most = params.read(len(space.centroids))
                for i in range(0, len(mine), 512):
                    at = pa.array(mine[i : i + 512])
                    x, ids = _matrix(batch.column("vec").take(at)).astype(np.float32), batch.column("id").take(at)
                    lists, d = graphs[name].search(_unit(x).astype(np.float32), most)
                    a, b = np.nonzero((d <= d[:, :1] * (1 + params.probe_ratio)) | (np.arange(d.shape[1]) < least))
                    lists = lists[a, b]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(lists + space.first, pa.int32()), pa.array(np.zeros(len(lists), np.int32), mask=space.leaves[lists] > 1), ids.take(pa.array(a)), _packed(x[a]),
                    ], schema=schema)

    return queries.select("space", "id", "vec").mapInArrow(run, "list int, leaf int, query long, qvec binary")


def with_leaves(held: DataFrame, asked: DataFrame, spaces: dict[str, Space], params: ListParams) -> tuple[DataFrame, DataFrame]:
    """Postings and probes with the leaves of divided lists.

    Each divided list has centroids fitted on a sample of its vectors by hash. Vectors meet them by list and part,
    queries by list and block, so a list of any length is many tasks. Of the leaves of all its lists a query reads
    those within the ratio of its nearest one.
    """
    numbers = {int(s.first + i): (int(s.leaves[i]), int(s.parts[i])) for s in spaces.values() for i in np.flatnonzero(s.leaves > 1)}
    if not numbers:
        return held, asked
    spark = held.sparkSession
    divided = spark.createDataFrame([(i, m, p) for i, (m, p) in numbers.items()], "list int, m long, parts int")  # at most top_lists a space
    long, wide = held.where("leaf is null").drop("leaf"), asked.where("leaf is null").drop("leaf")
    rate = F.lit(params.per_list / params.list_rows)
    sample = long.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) / float(1 << 30) < rate).select("list", "vec").join(divided, "list")

    def fit(table: pa.Table) -> pa.Table:
        c, _ = balanced_centroids(_unit(_unpacked(table.column("vec"))), table.column("m")[0].as_py(), params.iterations, params.seed)
        return pa.table({"list": pa.array([table.column("list")[0].as_py()], pa.int32()), "parts": pa.array([table.column("parts")[0].as_py()], pa.int32()), "c": pa.array([c.tobytes()], pa.binary()), "width": pa.array([c.shape[1]], pa.int32())})

    fitted = written(sample.groupBy("list").applyInArrow(fit, "list int, parts int, c binary, width int"), "leaves")

    def centroids(table: pa.Table) -> np.ndarray | None:
        return np.frombuffer(table.column("c")[0].as_py(), np.float32).reshape(-1, table.column("width")[0].as_py()) if table.num_rows else None

    def place(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        c, x = centroids(leaves), _unpacked(rows.column("vec")) if rows.num_rows else np.zeros((0, 1), np.float32)
        # a list too short for a sample stays whole, as leaf 0
        a, b = _lists_of(_unit(x), c, params.replicas, params.boundary) if c is not None and len(x) else (np.arange(len(x)), np.zeros(len(x), np.int64))
        taken = rows.take(pa.array(a))
        return pa.table({"list": taken.column("list"), "leaf": pa.array(b, pa.int32()), "part": pa.array(np.zeros(len(a), np.int32)), "vec": taken.column("vec"), "ids": taken.column("ids")})

    every = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = long.groupBy("list", "part").cogroup(every.groupBy("list", "part")).applyInArrow(place, "list int, leaf int, part int, vec binary, ids array<long>")

    def choose(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        c, n = centroids(leaves), rows.num_rows
        q = _unit(_unpacked(rows.column("qvec"))).astype(np.float32) if n else np.zeros((0, 1), np.float32)
        a, b, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if c is None:
            a, b, d = [np.arange(n)], [np.zeros(n, np.int64)], [np.zeros(n)]
        for i in range(0, len(q) if c is not None else 0, 512):
            far = np.sqrt(np.maximum(0, 2 - 2 * (q[i : i + 512] @ c.T)))
            most = min(params.read(len(c))[1], len(c))
            top = np.argpartition(far, most - 1, axis=1)[:, :most]
            a.append(np.repeat(np.arange(i, i + len(far)), most))
            b.append(top.ravel())
            d.append(np.take_along_axis(far, top, 1).ravel())
        at = np.concatenate(a)
        taken = rows.take(pa.array(at))
        return pa.table({"list": taken.column("list"), "leaf": pa.array(np.concatenate(b), pa.int32()), "query": taken.column("query"), "qvec": taken.column("qvec"), "d": pa.array(np.concatenate(d).astype(np.float64))})

    blocks = 1 + F.least(F.col("m"), F.lit(64))
    dealt = wide.join(F.broadcast(divided), "list").withColumn("block", F.pmod(F.xxhash64("query"), blocks)).select("list", "block", "query", "qvec")
    by_block = fitted.join(F.broadcast(divided.select("list", "m")), "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    near = dealt.groupBy("list", "block").cogroup(by_block.groupBy("list", "block")).applyInArrow(choose, "list int, leaf int, query long, qvec binary, d double")
    least, most = params.read(sum(m for m, _ in numbers.values()))
    ordered = F.array_sort(F.collect_list(F.struct("d", "list", "leaf")))  # of at most the lists times the leaves that a query reads
    best = near.groupBy("query").agg(F.slice(ordered, 1, most).alias("top"), F.min("qvec").alias("qvec"))
    best = best.select("query", "qvec", F.posexplode("top").alias("place", "t"), F.col("top")[0]["d"].alias("d0"))
    chosen = best.where((F.col("place") < least) | (F.col("t.d") <= F.col("d0") * (1 + params.probe_ratio))).select("t.list", "t.leaf", "query", "qvec")
    return held.where("leaf is not null").unionByName(placed), asked.where("leaf is not null").unionByName(chosen)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, params: ListParams = ListParams()) -> DataFrame:
    """(query, neighbor, rank, cosine): the k most similar other ids of each query within its space.

    ``vectors`` and ``queries``: space STRING, id BIGINT, vec ARRAY<FLOAT>, usable vectors only (see ``usable``) and one
    width a space. Repeated ids count once, equal similarities are ordered by id, a query id is never its own
    neighbour. Spaces with fewer than k other vectors give fewer rows; no vectors: no rows.
    """
    spaces = fit_spaces(vectors, params)
    spark = vectors.sparkSession
    if not spaces:
        return spark.createDataFrame([], "query long, neighbor long, rank int, cosine double")
    asked = written(probes(queries.dropDuplicates(["space", "id"]), spaces, params), "probes")
    wanted = F.broadcast(asked.select("list").distinct())  # numbers of lists: at most top_lists a space
    held = posting_lists(vectors, spaces, k, params).join(wanted, "list", "left_semi")
    if any((s.leaves > 1).any() for s in spaces.values()):
        held, asked = with_leaves(written(held, "postings"), asked, spaces, params)
        asked = written(asked, "leaf_probes")
    parts = {int(s.first + i): int(s.parts[i]) for s in spaces.values() for i in np.flatnonzero((s.parts > 1) & (s.leaves == 1))}
    if parts:
        many = spark.createDataFrame(list(parts.items()), "list int, parts int")  # at most top_lists a space
        asked = asked.join(F.broadcast(many), "list", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        asked = asked.withColumn("part", F.lit(0))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            x, q = _unit(_unpacked(left.column("vec"))), _unit(_unpacked(right.column("qvec")))
            ids, by = left.column("ids").combine_chunks(), right.column("query").to_numpy()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            count, flat = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy()
            start, m = np.cumsum(count) - count, min(len(x), k + 1)
            for i in range(0, len(q), 512):
                sim = np.round(q[i : i + 512] @ x.T, 12)
                kth = -np.partition(-sim, m - 1, axis=1)[:, m - 1 : m]
                a, b = np.nonzero(sim >= kth)  # ties with the last all stay
                s, n = sim[a, b], count[b]
                at = np.repeat(start[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                asked_by, other, s = np.repeat(by[i + a], n), flat[at], np.repeat(s, n)
                other_ones = asked_by != other
                asked_by, other, s = asked_by[other_ones], other[other_ones], s[other_ones]
                order = np.lexsort((other, -s, asked_by))
                asked_by, other, s = asked_by[order], other[order], s[order]
                once = np.r_[True, (asked_by[1:] != asked_by[:-1]) | (other[1:] != other[:-1])][: len(other)]  # copies in several batches
                asked_by, other, s = asked_by[once], other[once], s[once]
                best = np.arange(len(other)) - np.searchsorted(asked_by, asked_by) < k
                found.append((asked_by[best], other[best], s[best]))
        query, neighbor, cosine = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
        return pa.table({"query": pa.array(query.astype(np.int64)), "neighbor": pa.array(neighbor.astype(np.int64)), "cosine": pa.array(cosine.astype(np.float64))})

    cells = ["list", "leaf", "part"]
    hits = held.groupBy(*cells).cogroup(asked.groupBy(*cells)).applyInArrow(search, "query long, neighbor long, cosine double")
    best = hits.groupBy("query", "neighbor").agg(F.max("cosine").alias("cosine"))
    return _top(best, k)


def _top(best: DataFrame, k: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbor")))  # of at most k a list that a query reads
    return (
        best.groupBy("query").agg(F.slice(ordered, 1, k).alias("top"))
        .select("query", F.posexplode("top").alias("rank", "t"))
        .select("query", F.col("t.neighbor").alias("neighbor"), (F.col("rank") + 1).cast("int").alias("rank"), (-F.col("t.far")).alias("cosine"))
    )
