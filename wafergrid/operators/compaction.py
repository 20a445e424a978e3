"""Few well-sized files out of very many tiny ones, each artifact exactly once.

Method: balanced longest-first scheduling. Only (key, size) pairs are scheduled: hashed into shards of a bounded
number of files, each shard gives its files, longest first, to the least loaded of its fixed output groups (a heap).
The contents then go to their group in one shuffle and are streamed through pyarrow, one output file a group.
The manifest is published by one rename, after the files were read back and hold what the input held.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wafergrid.session import fresh_path, shuffle_width, written


@dataclass(frozen=True)
class CompactionPlan:
    """``target_bytes``: wanted size of an output file. ``shard_files``: most files one scheduling task sees on average."""

    target_bytes: int = 128 << 20
    shard_files: int = 200_000

    def __post_init__(self) -> None:
        if self.target_bytes < 1 or self.shard_files < 1:
            raise ValueError("target_bytes and shard_files must be positive")


def longest_first(sizes: list[int], groups: int) -> list[int]:
    """The group of each size: longest first, each to the group with the least bytes so far (lowest number at ties)."""
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (load + sizes[i], g))
    return out


def schedule(files: DataFrame, key: str, size: str, plan: CompactionPlan) -> DataFrame:
    """(key, group) for each row of ``files``; keys must be unique and sizes not negative. Empty input: no rows.

    A group is named ``shard * 2**20 + number``. Ties are broken by the key, so a rerun gives the same groups.
    """
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    shards = max(1, math.ceil(n / plan.shard_files), math.ceil(total / (plan.target_bytes * 512)))
    target = plan.target_bytes

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        sizes = pdf["s"].tolist()
        groups = longest_first(sizes, max(1, round(sum(sizes) / target)))
        return pd.DataFrame({"k": pdf["k"].to_numpy(), "g": pdf["shard"].to_numpy() * (1 << 20) + groups})

    kind = files.schema[key].dataType.simpleString()
    rows = files.select(F.col(key).alias("k"), F.col(size).cast("long").alias("s"), F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
    return rows.groupBy("shard").applyInPandas(assign, f"k {kind}, g long").select(F.col("k").alias(key), F.col("g").alias("group"))


def _digest(columns: list[str]):
    """A number for the set of rows that doesn't depend on their order."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def _writer(root: str, schema_json: str, columns: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        sink = None
        now, rows, size = None, 0, 0

        def close():
            sink.close()
            fs.move(temp, f"{base}/part-{now:012d}.parquet")  # same name and content on a retry
            return pa.RecordBatch.from_pydict({"group": [now], "rows": [rows], "bytes": [size]})

        for batch in batches:
            ids = batch.column("group").to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if ids[a] != now:
                    if sink is not None:
                        yield close()
                    now, rows, size = int(ids[a]), 0, 0
                    temp = f"{base}/.{now:012d}-{uuid.uuid4().hex}"
                    sink = None
                part = batch.slice(a, b - a).select(columns)
                if sink is None:
                    sink = pq.ParquetWriter(temp, part.schema, filesystem=fs, compression="zstd")
                sink.write_batch(part)
                rows += b - a
                size += sum(batch.column("__bytes").slice(a, b - a).to_pylist())
        if sink is not None:
            yield close()

    return run


def compact(files: DataFrame, key: str, size: str, *, out: str | None = None, plan: CompactionPlan = CompactionPlan()) -> tuple[DataFrame, dict]:
    """Write each row of ``files`` (its columns hold the contents) exactly once into few Parquet files below ``out``.

    ``key`` must be unique and not null, ``size`` (bytes) not negative. Returns the rows as read from the published
    files, and the manifest. If what was written differs from what was read, nothing is published and ValueError is
    raised. No rows: a manifest without files.
    """
    spark: SparkSession = files.sparkSession
    out = (out or fresh_path(spark, "compacted")).rstrip("/")
    files = written(files, "to-compact")  # scheduled, moved and compared: read once from its sources
    columns = files.columns
    groups = schedule(files, key, size, plan)
    moved = files.join(groups, key).withColumn("__bytes", F.col(size).cast("long"))
    moved = moved.repartition(shuffle_width(spark), "group").sortWithinPartitions("group", key)
    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType())])
    staged = f"{out}/data-{uuid.uuid4().hex}"
    parts = written(moved.mapInArrow(_writer(staged, files.schema.json(), columns), schema), "parts")

    n_parts, n_rows, n_bytes, distinct = parts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.countDistinct("group")).first()
    result = spark.read.schema(files.schema).parquet(f"{staged}/*.parquet") if n_parts else spark.createDataFrame([], files.schema)
    want, got = (x.agg(F.count("*"), _digest(columns)).first() for x in (files, result))
    if tuple(want) != tuple(got) or n_rows != want[0] or distinct != n_parts:
        raise ValueError(f"compaction into {staged} not published: rows and digest {tuple(want)} read, {tuple(got)} written in {n_parts} parts of {n_rows} rows")
    manifest = {"data": staged, "files": n_parts, "rows": n_rows, "bytes": int(n_bytes), "digest": str(want[1])}
    _publish(out, manifest)
    return result, manifest


def _publish(out: str, manifest: dict) -> None:
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(out)
    fs.create_dir(base, recursive=True)
    temp = f"{base}/.manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(json.dumps(manifest, sort_keys=True).encode())
    fs.move(temp, f"{base}/MANIFEST.json")


def published(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the last published compaction below ``out``; files of one that failed are not seen."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(out.rstrip("/"))
    with fs.open_input_stream(f"{base}/MANIFEST.json") as f:
        manifest = json.loads(f.read())
    if not manifest["files"]:
        raise FileNotFoundError(f"{out} holds no files")
    return spark.read.parquet(f"{manifest['data']}/*.parquet")
