"""Items of varying length into containers of a fixed capacity.

Method: best-fit decreasing with a segment tree over remaining capacities. The tree has a leaf for each remaining
capacity 0..C with the number of open containers that have it; the tightest container that still takes an item is
the first leaf from the item's size on that isn't empty, found on one way up and down the tree.

Best-fit decreasing is one sequence, so items are dealt by hash into shards of a bounded number of items and each
shard is packed by itself: the cost is at most one badly filled container a shard, of thousands.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafergrid.session import written

SHARD_ITEMS = 100_000


class Tightest:
    """Segment tree over 0..capacity; ``find(x)`` gives the smallest remaining capacity >= x with an open container."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.base)

    def add(self, remaining: int, by: int) -> None:
        i = remaining + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def find(self, size: int) -> int:
        count, i = self.count, size + self.base
        if count[i]:
            return size
        while i > 1:
            if not i & 1 and count[i + 1]:  # a left child: what lies to the right is larger
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.base:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.base


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """The container of each size, none above ``capacity``. Largest first, equal sizes in the order given."""
    sizes = list(sizes)
    tree, bins = Tightest(capacity), [[] for _ in range(capacity + 1)]
    out, n = [0] * len(sizes), 0
    for i in np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable").tolist():
        size = sizes[i]
        left = tree.find(size)
        if left < 0:
            b, left, n = n, capacity, n + 1
        else:
            b = bins[left].pop()
            tree.add(left, -1)
        out[i] = b
        bins[left - size].append(b)
        tree.add(left - size, 1)
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, *, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, piece, n_pieces, n_tokens, container): every item whole in one container, or cut if larger than ``capacity``.

    An item above the capacity is cut into full pieces, each its own container, and a rest that is packed like other
    items; ``container`` is unique over all shards. NULL and negative sizes count as 0; items of size 0 take a place
    in the tightest open container. Keys must be unique; ties are broken by the key. No rows: no containers.
    """
    if capacity < 1 or shard_items < 1:
        raise ValueError("capacity and shard_items must be positive")
    kind = items.schema[key].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    items = written(items.select(F.col(key).alias("k"), n.alias("n")), "items")  # sizes are dear: counted once
    shards = max(1, math.ceil(items.count() / shard_items))
    rest = F.when(F.col("n") > 0, F.pmod(F.col("n") - 1, F.lit(capacity)) + 1).otherwise(0)  # 1..capacity
    rows = items.select("k", "n", ((F.col("n") - rest) / capacity).cast("long").alias("full"), rest.alias("rest"), F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard"))

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable").reset_index(drop=True)
        rest, full = pdf["rest"].to_numpy(), pdf["full"].to_numpy()
        b = np.array(best_fit_decreasing(rest.tolist(), capacity), dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(full)[:-1]]) + (b.max() + 1)  # numbers of the full containers
        again = np.repeat(np.arange(len(pdf)), full)
        piece = np.arange(len(again)) - np.repeat(np.cumsum(full) - full, full)
        out = pd.DataFrame({
            "k": np.concatenate([pdf["k"].to_numpy(), pdf["k"].to_numpy()[again]]),
            "piece": np.concatenate([full, piece]),
            "n_pieces": np.concatenate([full + 1, full[again] + 1]),
            "n_tokens": np.concatenate([rest, np.full(len(again), capacity)]),
            "container": np.concatenate([b, at[again] + piece]),
        })
        out["container"] += int(pdf["shard"].iloc[0]) << 40
        return out

    packed = rows.groupBy("shard").applyInPandas(pack_shard, f"k {kind}, piece long, n_pieces long, n_tokens long, container long")
    return packed.withColumnRenamed("k", key)
