"""Copies of the smallest test data that are empty, hold rows of nothing but NULL and repeated rows, or have columns of clashing names."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from tests.oracle import DATA

KINDS = ("empty", "nulls", "clashes")
CLASHES = ("key", "space", "words", "train", "group", "part", "rank", "place", "n", "value", "id", "vec", "text_", "label_", "shard", "size", "ids", "p", "count")


def make(kind: str, folder: Path) -> str:
    for f in sorted(DATA.glob("*.parquet")):
        t = pq.read_table(f)
        if kind == "empty":
            t = t.slice(0, 0)
        elif kind == "nulls":
            none = pa.table({c.name: pa.nulls(1, c.type) for c in t.schema}, schema=t.schema)
            t = pa.concat_tables([t, none, t.slice(0, 20), none])
        else:
            for name in CLASHES:
                if name not in t.column_names:
                    t = t.append_column(name, pa.array(["x"] * len(t)))
        pq.write_table(t, folder / f.name)
    return str(folder)
