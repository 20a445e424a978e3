"""Percentiles of very large numeric columns per group, from summaries that can be put together later.

A summary holds, for each group and part (a day, a file), how often each value occurs, the values rounded to a stated
relative error (none, if so asked). Summaries are kept in a store, one folder a delivery, and later calls add to it;
the counts of all deliveries are put together by adding them.

Method: distributed multi-select over the summaries. The rows of a group are dealt into cells of bounded size by the
hash of the value. In each round every cell proposes the median of what it holds of the open range of each target
(group and percentile), and the medians of the halves, quarters and eighths on either side of it, which saves rounds;
of the proposals of all cells the weighted medians at the same places are the pivots; each cell counts what lies
below, at and above each pivot, and the ranges that can't hold the target are discarded. This goes on until each target
is a pivot. Ranks are exact: the only error is that of the rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wafergrid.session import published, published_names, written

#: About so many distinct values a cell (16 bytes each).
CELL_ROWS = 8_192
#: A round halves each open range so often.
HALVINGS = 5


def rounded(value: Column, bits: int) -> Column:
    """``value`` to ``bits`` binary digits after the first: off by at most ``2**-bits`` of its size. 0 stays 0."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - bits)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.bround(value / step) * step)


def finite(value: Column, bits: int | None) -> Column:
    """``value`` as a DOUBLE, rounded to ``bits`` if so asked; NULL where it is NULL, NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), (v if bits is None else rounded(v, bits)) + 0.0)


def summarize(rows: DataFrame, group: Sequence[str], part: str, value: str, *, bits: int | None) -> DataFrame:
    """(group..., part, value, n). NULL, NaN and infinite values are left out; ``bits=None`` keeps values as they are."""
    rows = rows.select(*group, part, finite(F.col(value), bits).alias("value")).where("value is not null")
    return rows.groupBy(*group, part, "value").agg(F.count("*").alias("n"))


def save_summary(summary: DataFrame, store: str, delivery: str) -> None:
    """Add a summary to a store under the name of its delivery. A delivery that the store has already isn't added again, so a repeated call counts nothing twice."""
    published(summary, f"{store.rstrip('/')}/delivery={delivery}")


def saved_summaries(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of all deliveries of a store, or None if it has none."""
    names = published_names(spark, store)
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{store.rstrip('/')}/{n}") for n in names]) if names else None


def merge(summaries: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """(group..., value, n) of all parts of all summaries; equal values meet in ``multi_select``."""
    return reduce(DataFrame.unionByName, [s.select(*group, "value", "n") for s in summaries])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gid, cell, value, n), those of a cell together, to (gid, v, upto): of each cell its values in order and how many rows lie at or below each."""

    def packed(gid: np.ndarray, value: np.ndarray, n: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        vs, us = [], []
        for a, b in zip(starts[:-1], starts[1:]):
            order = np.argsort(value[a:b])
            v, at = np.unique(value[a:b][order], return_index=True)
            vs.append(v.tobytes())
            us.append(np.cumsum(np.add.reduceat(n[a:b][order], at)).tobytes())
        return pa.RecordBatch.from_pydict({"gid": pa.array(gid[starts[:-1]], pa.int64()), "v": pa.array(vs, pa.binary()), "upto": pa.array(us, pa.binary())})

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        cols = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
        gid, cell, value, n = cols
        if not len(gid):
            continue
        starts = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (cell[1:] != cell[:-1])])
        if len(starts) > 1:  # the last one may go on in the next batch
            yield packed(gid, value, n, starts)
        held = [c[starts[-1] :] for c in cols]
    if held is not None:
        yield packed(held[0], held[2], held[3], np.array([0, len(held[0])]))


_STATE = "gid long, ranks binary, lo binary, hi binary, found binary"


def _state(row: dict) -> list[np.ndarray]:
    return [np.frombuffer(row["ranks"], np.int64), *(np.frombuffer(row[c], np.float64) for c in ("lo", "hi", "found"))]


def _medians(v: np.ndarray, w: np.ndarray, halvings: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values with weights the weighted median, those of the halves, and so on, and the weight each stands for."""
    if len(v) < 1 << halvings:
        return v, w
    c = np.cumsum(w)
    at = np.unique(np.searchsorted(c, c[-1] * np.arange(1, 1 << halvings) / (1 << halvings)))
    edges = (at[1:] + at[:-1]) // 2
    total = c[np.r_[edges, len(v) - 1]]
    return v[at], np.diff(total, prepend=0)


def _pooled(points: list[tuple[np.ndarray, np.ndarray]], halvings: int) -> tuple[np.ndarray, np.ndarray]:
    if len(points) == 1:
        return points[0]
    v, w = (np.concatenate(x) for x in zip(*points))
    v, back = np.unique(v, return_inverse=True)
    return _medians(v, np.bincount(back, w), halvings)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for r in zip(*cols):
            yield dict(zip(batch.schema.names, r))


def _proposals(halvings: int):
    """Each cell's medians, put together within a task: (gid, target, m, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for r in _rows(batches):
            v, upto = np.frombuffer(r["v"], np.float64), np.frombuffer(r["upto"], np.int64)
            _, lo, hi, found = _state(r)
            n = np.diff(upto, prepend=0)
            for t in np.flatnonzero(np.isnan(found)):
                a, b = np.searchsorted(v, lo[t], "right"), np.searchsorted(v, hi[t], "left")
                if a < b:
                    mine = held.setdefault((r["gid"], int(t)), [])
                    mine.append(_medians(v[a:b], n[a:b], halvings))
                    if len(mine) > 64:
                        mine[:] = [_pooled(mine, halvings + 2)]
        out = [(g, t, *_pooled(p, halvings + 2)) for (g, t), p in held.items()]
        yield pa.RecordBatch.from_pydict({
            "gid": pa.array([o[0] for o in out], pa.int64()), "target": pa.array([o[1] for o in out], pa.int32()),
            "m": pa.array([o[2].tobytes() for o in out], pa.binary()), "w": pa.array([o[3].astype(np.float64).tobytes() for o in out], pa.binary()),
        })

    return run


def _pivots(halvings: int):
    """The weighted medians of the proposals of one group: at most one row a task and target are met."""

    def run(table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for t, m, w in zip(*(table.column(c).to_pylist() for c in ("target", "m", "w"))):
            by.setdefault(t, []).append((np.frombuffer(m, np.float64), np.frombuffer(w, np.float64)))
        pivots = [(t, _medians(*_pooled(p, halvings + 2), halvings)[0]) for t, p in sorted(by.items())]
        flat, targets = np.concatenate([p for _, p in pivots]), np.concatenate([np.full(len(p), t) for t, p in pivots])
        return pa.table({"gid": table.column("gid").slice(0, 1), "pivots": pa.array([flat.tobytes()], pa.binary()), "of": pa.array([targets.astype(np.int64).tobytes()], pa.binary())})

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the rows of a task's cells below, and at or below, each pivot within its target's open range, with the group's state."""
    held: dict[int, list] = {}
    for r in _rows(batches):
        v, upto = np.frombuffer(r["v"], np.float64), np.concatenate([[0], np.frombuffer(r["upto"], np.int64)])
        _, lo, _, _ = _state(r)
        pivots, of = np.frombuffer(r["pivots"], np.float64), np.frombuffer(r["of"], np.int64)
        start = upto[np.searchsorted(v, lo[of], "right")]
        two = np.stack([upto[np.searchsorted(v, pivots, s)] - start for s in ("left", "right")])
        if r["gid"] in held:
            held[r["gid"]][1] += two
        else:
            held[r["gid"]] = [r, two]
    kept = ("ranks", "lo", "hi", "found", "pivots", "of")
    yield pa.RecordBatch.from_pydict(
        {"gid": pa.array(list(held), pa.int64())} | {c: pa.array([h[0][c] for h in held.values()], pa.binary()) for c in kept}
        | {"counts": pa.array([h[1].astype(np.int64).tobytes() for h in held.values()], pa.binary())}
    )


def _discarded(table: pa.Table) -> pa.Table:
    """The state of one group after its counts are added up: one row a task is met."""
    r = {c: table.column(c)[0].as_py() for c in table.column_names}
    ranks, lo, hi, found = (x.copy() for x in _state(r))
    pivots, of = np.frombuffer(r["pivots"], np.float64), np.frombuffer(r["of"], np.int64)
    below, upto = sum(np.frombuffer(c, np.int64).reshape(2, -1) for c in table.column("counts").to_pylist())
    for t in np.unique(of):
        at = np.flatnonzero(of == t)
        i = int(np.searchsorted(upto[at], ranks[t]))  # the first pivot that the target isn't above
        if i < len(at) and below[at[i]] < ranks[t]:
            found[t] = pivots[at[i]]
            continue
        if i < len(at):
            hi[t] = pivots[at[i]]
        if i:
            lo[t] = pivots[at[i - 1]]
            ranks[t] -= upto[at[i - 1]]
    out = {"ranks": ranks, "lo": lo, "hi": hi, "found": found}
    return pa.table({"gid": table.column("gid").slice(0, 1)} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in out.items()})


def multi_select(points: DataFrame, group: Sequence[str], percentiles: Sequence[float], *, cell_rows: int = CELL_ROWS, halvings: int = HALVINGS) -> DataFrame:
    """(group..., p, n_values, value): of each group the smallest value with at least ``p`` of the group's rows at or below it.

    ``points``: group..., value DOUBLE (finite), n BIGINT (see ``merge``); equal values of a group count together. NULL
    is a group like any other. No points: no rows. A group of any size is spread over cells; a task holds one cell at
    a time and, of each group it meets, the proposals and counts of its targets.
    """
    if not percentiles or not all(0 < p <= 1 for p in percentiles):
        raise ValueError("percentiles lie above 0 and at most at 1")
    if cell_rows < 1 or halvings < 1:
        raise ValueError("cell_rows and halvings are positive")
    group, ps = list(group), [float(p) for p in percentiles]
    totals = points.groupBy(*group).agg(F.sum("n").cast("long").alias("n_values"), F.count("*").alias("rows"))
    totals = written(totals.withColumn("gid", F.monotonically_increasing_id()), "totals")
    t = totals.select("gid", F.ceil(F.col("rows") / cell_rows).alias("cells"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)])
    same = reduce(lambda a, b: a & b, [points[g].eqNullSafe(t[f"__g{i}"]) for i, g in enumerate(group)], F.lit(True))
    dealt = points.join(t, same).select("gid", F.pmod(F.xxhash64("value"), F.col("cells")).alias("cell"), "value", F.col("n").cast("long").alias("n"))
    dealt = dealt.repartition("gid", "cell").sortWithinPartitions("gid", "cell")
    cells = written(dealt.mapInArrow(_cells, "gid long, v binary, upto binary"), "cells")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids, ns = batch.column(0), batch.column(1).to_pylist()
            none, k = np.full(len(ps), np.nan).tobytes(), len(gids)
            lo, hi = (np.full(len(ps), s * np.inf).tobytes() for s in (-1, 1))
            ranks = [np.array([min(max(1, math.ceil(p * n)), n) for p in ps], np.int64).tobytes() for n in ns]
            cols = {"ranks": ranks, "lo": [lo] * k, "hi": [hi] * k, "found": [none] * k}
            yield pa.RecordBatch.from_pydict({"gid": gids} | {c: pa.array(x, pa.binary()) for c, x in cols.items()})

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            found = np.frombuffer(r["found"], np.float64)
            yield pa.RecordBatch.from_pydict({"gid": pa.array([r["gid"]] * len(ps), pa.int64()), "p": pa.array(ps), "value": pa.array(found)})

    pending = totals.select("gid", "n_values").mapInArrow(first, _STATE)
    done: list[DataFrame] = []
    while True:
        proposed = cells.join(pending, "gid").mapInArrow(_proposals(halvings), "gid long, target int, m binary, w binary")
        pivots = proposed.groupBy("gid").applyInArrow(_pivots(halvings), "gid long, pivots binary, of binary")
        counted = cells.join(pending.join(pivots, "gid"), "gid").mapInArrow(_counted, _STATE + ", pivots binary, of binary, counts binary")
        state = written(counted.groupBy("gid").applyInArrow(_discarded, _STATE).withColumn("open", _any_open("found")), "state")
        done.append(state.where("not open").drop("open"))
        pending = state.where("open").drop("open")
        if not pending.limit(1).count():
            break
    values = reduce(DataFrame.unionByName, done).mapInArrow(ended, "gid long, p double, value double")
    return values.join(totals, "gid").select(*group, "p", "n_values", "value")


def _any_open(found: str) -> Column:
    """Whether one of the packed values is the NaN that stands for a target that isn't found: none of the others is NaN."""
    nan = F.lit(np.array([np.nan]).tobytes().hex().upper())
    digits = F.hex(F.col(found))
    return F.exists(F.sequence(F.lit(1), F.length(digits), F.lit(16)), lambda i: F.substr(digits, i, F.lit(16)) == nan)
