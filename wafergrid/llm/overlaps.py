"""Records of evaluation splits that show the same image, or almost the same, as a training record.

Method: minwise hashes of shingles in banded buckets; only pairs across the splits become candidates; of these the
exact Jaccard similarity of the shingle sets is computed, and at last the condition itself, the correlation of thumbs.

A thumb's shingles are its quantised grey values. The 64 values less their mean and divided by their deviation are cut
into steps, once for each of several offsets of the steps; a shingle is a pixel, an offset and the step that the value
falls into, so every thumb has as many. Of a pixel whose values differ by d the two thumbs share the part 1 - d / step of
the shingles, whatever the values are. Thumbs at a correlation of r differ by sqrt(2 - 2 r) a pixel in the root mean square,
and so by no more than that on the average: with the defaults, at 0.95 they share 0.79 of their shingles or more, up to
the fineness of the offsets, and their Jaccard similarity is 0.65 or more. That holds for any layout of the boards and any
contrast, so no pair needs another way to be found.

Records are not compared one by one. Records whose images are the same, hash by hash and thumb by thumb, have one image
class; links are between classes, and copies are counted with them. A record's sample id in one spelling, and its image
hashes, are keys that need no verification.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafergrid.functions.paths import BLANK, once, strip_blank
from wafergrid.session import scratch_path, written

#: How the splits are written, in lower case without blanks at the ends.
TRAIN = ("train", "training")
EVALUATION = {"val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


@dataclass(frozen=True)
class BandParams:
    """Correlation asked for; least Jaccard similarity of the shingles, below what that correlation leaves; width of a step in
    deviations, and offsets; minwise hashes a thumb; bands, and hashes a band. A band takes its hashes from all of them,
    so several bands have one in common. With the defaults a pair at a correlation of exactly 0.95 becomes a candidate with a
    chance of 0.998, at 0.96 of 0.9998, and from 0.97 on none was missed in 10,000. ``together``: bands after which
    pairs that were found several times are made one; ``slice_thumbs``: the most thumbs that a task holds of a side."""

    correlation: float = 0.95
    jaccard: float = 0.6
    step: float = 1.5
    offsets: int = 8
    hashes: int = 512
    bands: int = 256
    rows: int = 10
    together: int = 32
    slice_thumbs: int = 65_536
    seed: int = 4880


def split_side(split: Column) -> Column:
    """'train', 'val', 'test' or NULL, however it is written."""
    s = F.lower(strip_blank(split))
    other = F.element_at(F.create_map(*[F.lit(x) for kv in EVALUATION.items() for x in kv]), s)
    return F.when(s.isin(*TRAIN), F.lit("train")).when(s.isin(*EVALUATION), other)


def with_sample_key(df: DataFrame, sample: str, key: str) -> DataFrame:
    """``df`` with one spelling of a sample id: narrow lower-case letters and digits, without separators, image suffixes and marks of copies. NULL stays; nothing left gives NULL."""
    c = F.lower(F.translate(F.translate(F.col(sample), _WIDE, _NARROW), BLANK, " " * len(BLANK)))
    bare = F.regexp_replace(F.btrim(c), r"(?:[\s_-]*(?:\.(?:png|jpe?g|bmp|gif|tiff?)|\(\d+\)|copy|dup))+\s*$", "")
    return once(df, key, F.nullif(F.regexp_replace(bare, r"[\s/\\_-]+", ""), F.lit("")))


def sha_key(sha: Column) -> Column:
    """The 64 hex digits of a SHA-256, however it is written; anything else gives NULL."""
    s = F.regexp_replace(F.lower(strip_blank(sha)), r"^sha-?256:\s*", "")
    return F.when(s.rlike("^[0-9a-f]{64}$"), s)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last column: 64 small integers to 64 bytes, or to 128 if one of them lies outside 0 to 255; thumbs of another size, with nulls or without any contrast to NULL."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        out: list[bytes | None] = [None] * len(column)
        at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), 64), False).to_numpy(zero_copy_only=False))
        if len(at):
            values = column.take(pa.array(at)).flatten()
            whole = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 64).all(1)
            x = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).reshape(-1, 64)
            narrow = (x.min(1) >= 0) & (x.max(1) < 256)
            for i, row, small in zip(at[good := whole & (x.min(1) < x.max(1))].tolist(), x[good], narrow[good].tolist()):
                out[i] = row.astype("u1" if small else "<i2").tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=batch.schema.names)


def _standard(thumbs: list[bytes]) -> np.ndarray:
    """Rows of packed thumbs less their mean, of length 1."""
    x = np.empty((len(thumbs), 64))
    if len(data := b"".join(thumbs)) == 64 * len(thumbs) and all(len(t) == 64 for t in thumbs):
        x[:] = np.frombuffer(data, "u1").reshape(-1, 64)
        return _centred(x)
    for size, kind in ((64, "u1"), (128, "<i2")):
        at = [i for i, t in enumerate(thumbs) if len(t) == size]
        if at:
            x[at] = np.frombuffer(b"".join([thumbs[i] for i in at]), kind).reshape(len(at), 64)
    return _centred(x)


def _centred(x: np.ndarray) -> np.ndarray:
    x -= x.mean(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(z: np.ndarray, params: BandParams) -> np.ndarray:
    """Rows of ``_standard`` as whole numbers of the distance between two offsets: the steps of all offsets follow from these."""
    return np.floor(z * (8 * params.offsets / params.step)).astype(np.int8)


def jaccard(p: np.ndarray, q: np.ndarray, params: BandParams) -> np.ndarray:
    """Jaccard similarity of the shingle sets of quantised thumbs, row by row: of so many offsets two values share the steps of all but as many as they differ by."""
    n = params.offsets
    common = np.maximum(n - np.abs(p - q), 0).sum(1, dtype=np.int32)
    return common / (2 * n * p.shape[1] - common)


class _Hasher:
    """Minwise hashes of quantised thumbs, and from these the buckets of a band."""

    def __init__(self, params: BandParams) -> None:
        n, levels = params.offsets, 2 * math.ceil(8 / params.step) + 2  # standardised values lie between -8 and 8
        rng = np.random.default_rng(params.seed)
        ranks = rng.integers(0, 1 << 16, (64 * n * levels, params.hashes), dtype=np.uint16).reshape(64, n, levels, params.hashes)  # of each shingle in each order
        self.taken = np.stack([rng.choice(params.hashes, params.rows, replace=False) for _ in range(params.bands)])
        self.odd = rng.integers(0, 1 << 63, (params.rows, params.bands)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, params.bands).astype(np.uint64)
        self.low = math.ceil(8 * n / params.step) + 1
        value = np.arange(-self.low, self.low)
        step = lambda i: np.clip((value + i) // n + levels // 2, 0, levels - 1)
        #: By pixel and quantised value the least ranks of the shingles of all offsets.
        self.ranks = np.minimum.reduce([ranks[:, i, step(i)] for i in range(n)])

    def hashes(self, q: np.ndarray) -> np.ndarray:
        """Of each order the least rank of each thumb, an order a row."""
        out = np.empty((self.ranks.shape[2], len(q)), np.uint16)
        for i in range(0, len(q), 512):
            at = q[i : i + 512].astype(np.int64) + self.low
            least = self.ranks[0][at[:, 0]]
            for j in range(1, 64):
                np.minimum(least, self.ranks[j][at[:, j]], out=least)
            out[:, i : i + 512] = least.T
        return out

    def buckets(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """Of 32 bits, since chance brings two thumbs together far less often than their shingles do."""
        bucket = np.full(hashes.shape[1], self.salt[band])
        for r, k in enumerate(self.taken[band]):
            bucket += (hashes[k].astype(np.uint64) + np.uint64(1)) * self.odd[r, band]
            bucket ^= bucket >> np.uint64(29)
        return (bucket >> np.uint64(32)).astype(np.uint32)


def _candidates(one: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``one`` and of ``other`` that are in one bucket, about 65,536 pairs at a time, however many thumbs a bucket has."""
    order = np.argsort(other)
    other = other[order]
    low = np.searchsorted(other, one, "left")
    hit = np.flatnonzero(other[np.minimum(low, len(other) - 1)] == one)
    low = low[hit]
    many = np.searchsorted(other, one[hit], "right") - low
    ends, start = np.cumsum(many), 0
    while start < len(many):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 65_536, "right")))
        n = many[start:stop]
        x = np.repeat(hit[start:stop], n)
        y = order[np.repeat(low[start:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        for k in range(0, len(x), 65_536):
            yield x[k : k + 65_536], y[k : k + 65_536]
        start = stop


class _Block:
    """Thumbs of the files of a block: class ids, standardised values as they are needed, quantised values, minwise hashes."""

    def __init__(self, files: list[str], hasher: _Hasher, params: BandParams) -> None:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        read = []
        for uri in files:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                read.append(pq.ParquetFile(f).read(columns=["class_id", "thumb"]))
        rows = pa.concat_tables(read)
        self.ids, self.thumbs = rows.column("class_id").to_numpy(), rows.column("thumb").combine_chunks()
        self.quantised = np.empty((len(self.ids), 64), np.int8)
        for i in range(0, len(self.ids), 8_192):
            self.quantised[i : i + 8_192] = quantised(_standard(self.thumbs.slice(i, 8_192).to_pylist()), params)
        self.hashes = hasher.hashes(self.quantised)

    def standard(self, at: np.ndarray) -> np.ndarray:
        return _standard(self.thumbs.take(pa.array(at)).to_pylist())


def _alike(one: _Block, other: _Block, hasher: _Hasher, params: BandParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class ids of the pairs near enough, each once. Those found so far are held once too, though many bands find them again."""
    codes, found, size = np.zeros(0, np.int64), [], 0
    for band in range(params.bands):
        for x, y in _candidates(hasher.buckets(one.hashes, band), hasher.buckets(other.hashes, band)):
            good = (jaccard(one.quantised[x], other.quantised[y], params) >= params.jaccard) & (one.ids[x] != other.ids[y])
            if good.any():
                found.append(x[good] * len(other.ids) + y[good])
                size += len(found[-1])
                if size > max(1 << 20, len(codes)):
                    codes, found, size = np.unique(np.concatenate([codes, *found])), [], 0
        if band % params.together == params.together - 1 or band == params.bands - 1:
            codes, found, size = np.unique(np.concatenate([codes, *found])), [], 0
    for i in range(0, len(codes), 65_536):
        x, y = np.divmod(codes[i : i + 65_536], len(other.ids))
        near = (one.standard(x) * other.standard(y)).sum(1) >= params.correlation - 1e-12
        yield one.ids[x[near]], other.ids[y[near]]


def _blocks(classes: DataFrame, size: int, name: str) -> list[list[str]]:
    """``classes`` written to files of at most ``size`` rows; blocks of files that together have no more."""
    spark = classes.sparkSession
    classes.write.option("maxRecordsPerFile", size).parquet(path := scratch_path(spark, name))
    out, room = [], 0
    for file, n in sorted(spark.read.schema(classes.schema).parquet(path).groupBy("_metadata.file_path").count().collect()):
        if n > room:
            out.append([])
            room = size
        out[-1].append(file)
        room -= n
    return out


def near_thumbs(classes: DataFrame, params: BandParams) -> DataFrame:
    """(a, b): class ids of different thumbs, a with a training and b with an evaluation record, near enough.

    ``classes``: class_id, thumb BINARY (see ``_packed``), train and eval BOOLEAN. Thumbs of either side are written in
    blocks, once; each block of one side meets each of the other in a task, which makes their buckets, looks these through
    band by band, and verifies what it finds. Buckets and candidates are neither stored nor shuffled, so that disk follows the
    thumbs; only pairs that are near enough leave a task.
    """
    spark = classes.sparkSession
    n, m = classes.agg(F.count_if("train"), F.count_if("eval")).first()
    tasks = 2 * spark.sparkContext.defaultParallelism
    across = max(1, -(-m // params.slice_thumbs))
    size = min(params.slice_thumbs, max(params.slice_thumbs // 16, -(-n * across // tasks)))
    left, right = (_blocks(classes.where(side).select("class_id", "thumb"), k, side) for side, k in (("train", size), ("eval", params.slice_thumbs)))
    pairs = len(left) * len(right)
    if not pairs:
        return spark.createDataFrame([], "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at, one = _Hasher(params), -1, None
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, j = divmod(k, len(right))
                if i != at:
                    one = None  # before the next is read
                    at, one = i, _Block(left[i], hasher, params)
                for a, b in _alike(one, _Block(right[j], hasher, params), hasher, params):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = min(pairs, max(4 * tasks, -(-pairs // 16)))
    return spark.range(0, pairs, 1, parts).mapInArrow(run, "a long, b long")


@dataclass(frozen=True)
class Overlaps:
    """``records``: record_id, dataset, split ('train', 'val', 'test'), train BOOLEAN, sample_class (NULL without a sample id), image_class (NULL
    without images). ``links``: train_class, eval_class, sha256, thumb: pairs of image classes with a common hash, and
    with equal or near thumbs; a class of both sides is linked with itself."""

    records: DataFrame
    links: DataFrame


def overlaps(records: DataFrame, images: DataFrame, params: BandParams = BandParams()) -> Overlaps:
    """Classes of the records and the links between those of the two sides.

    ``records``: record_id, dataset, sample_id, split; repeated rows count once, a split that is NULL or unknown takes
    no part. ``images``: sample_id, image_sha256, thumb ARRAY<SMALLINT>; a record has all rows with its sample_id
    exactly as stored. NULL ids, hashes and thumbs, and thumbs without contrast, match nothing. An image class is told
    by the number of its keys and two sums of their 64-bit hashes.
    """
    side = split_side(F.col("split"))
    rows = records.select("record_id", "dataset", "sample_id", side.alias("split")).where("split is not null and record_id is not null").distinct()
    rows = with_sample_key(rows, "sample_id", "sample_key").withColumn("train", F.expr("split = 'train'"))
    sample = F.concat_ws("/", F.lower(strip_blank(F.col("dataset"))), "sample_key")
    rows = written(rows.select("record_id", "dataset", "split", "train", "sample_id", F.when(F.col("sample_key").isNotNull() & F.col("dataset").isNotNull(), sample).alias("sample_class")), "records")

    used = rows.where("sample_id is not null").groupBy("sample_id").agg(F.bool_or("train").alias("train"), F.bool_or(~F.col("train")).alias("eval"))
    images = images.where("sample_id is not null")
    hashed = images.select("sample_id", F.lit(True).alias("sha256"), F.unhex(sha_key(F.col("image_sha256"))).alias("key"))
    seen = images.where("thumb is not null").select("sample_id", "thumb").mapInArrow(_packed, "sample_id string, thumb binary").select("sample_id", F.lit(False).alias("sha256"), F.col("thumb").alias("key"))
    shown = written(hashed.unionByName(seen).where("key is not null").distinct().join(used, "sample_id"), "shown")

    hashes = [F.sum(F.xxhash64(F.lit(i), "sha256", "key").cast("decimal(20,0)")).cast("string") for i in (1, 2)]
    told = shown.groupBy("sample_id", "train", "eval").agg(F.concat_ws(":", F.count("*").cast("string"), *hashes).alias("told"))
    told = written(told, "told")
    classes = told.groupBy("told").agg(F.min("sample_id").alias("sample_id"), F.bool_or("train").alias("train"), F.bool_or("eval").alias("eval"))
    classes = written(classes.withColumn("image_class", F.monotonically_increasing_id()), "image_classes")
    members = told.select("sample_id", "told").join(classes.select("told", "image_class"), "told").select("sample_id", "image_class")
    placed = written(rows.join(members, "sample_id", "left").select("record_id", "dataset", "split", "train", "sample_class", "image_class"), "placed")

    keys = written(shown.select("sample_id", "sha256", "key").join(classes, "sample_id").select("image_class", "sha256", "key", "train", "eval"), "keys")
    side = lambda df, is_train: df.where("train" if is_train else "eval")
    equal = side(keys, True).select("sha256", "key", F.col("image_class").alias("train_class")).join(side(keys, False).select("sha256", "key", F.col("image_class").alias("eval_class")), ["sha256", "key"])
    equal = equal.select("train_class", "eval_class", "sha256", (~F.col("sha256")).alias("thumb"))

    thumbs = keys.where("not sha256").groupBy(F.col("key").alias("thumb")).agg(F.bool_or("train").alias("train"), F.bool_or("eval").alias("eval"))
    thumbs = written(thumbs.withColumn("class_id", F.monotonically_increasing_id()), "thumbs")
    of = written(keys.where("not sha256").withColumnRenamed("key", "thumb").join(thumbs.select("thumb", "class_id"), "thumb").select("class_id", "image_class", "train", "eval"), "thumb_members")
    near = written(near_thumbs(thumbs, params), "near")
    near = near.join(side(of, True).select(F.col("class_id").alias("a"), F.col("image_class").alias("train_class")), "a").join(side(of, False).select(F.col("class_id").alias("b"), F.col("image_class").alias("eval_class")), "b")
    links = equal.unionByName(near.select("train_class", "eval_class", F.lit(False).alias("sha256"), F.lit(True).alias("thumb")))
    links = links.groupBy("train_class", "eval_class").agg(F.bool_or("sha256").alias("sha256"), F.bool_or("thumb").alias("thumb"))
    return Overlaps(placed, written(links, "links"))


def cross_split_pairs(records: DataFrame, images: DataFrame, params: BandParams = BandParams()) -> DataFrame:
    """(train_id, eval_id): each pair of records once, for whatever reason; see ``overlaps``. Copies are expanded into all pairs."""
    found = overlaps(records, images, params)
    train, other = (found.records.where(c) for c in ("train", "not train"))
    by_sample = train.where("sample_class is not null").select("sample_class", F.col("record_id").alias("train_id")).join(other.select("sample_class", F.col("record_id").alias("eval_id")), "sample_class")
    by_image = found.links.select("train_class", "eval_class").join(train.select(F.col("image_class").alias("train_class"), F.col("record_id").alias("train_id")), "train_class")
    by_image = by_image.join(other.select(F.col("image_class").alias("eval_class"), F.col("record_id").alias("eval_id")), "eval_class")
    return by_sample.select("train_id", "eval_id").unionByName(by_image.select("train_id", "eval_id")).distinct()


def link_counts(found: Overlaps, to_train: bool) -> DataFrame:
    """(sample_class, image_class, n_links, n_sample, n_sha256, n_thumb): of each pair of classes that records of one side have, with how many records of the other side one of them is linked, in all and for each reason. Pairs without links are missing.

    ``to_train``: count training records for those of evaluation, else the other way round. No pairs of records are
    made: the partners of an image class are counted by class, those of a sample class too, and those that are both are
    found by the pairs of image classes within a sample class.
    """
    mine, theirs = ("not train", "train") if to_train else ("train", "not train")
    own, other = ("eval_class", "train_class") if to_train else ("train_class", "eval_class")
    there = found.records.where(theirs)
    groups = found.records.where(mine).select("sample_class", "image_class").distinct()
    links = found.links.select(F.col(own).alias("image_class"), F.col(other).alias("other_class"), "sha256", "thumb")
    sizes = there.where("image_class is not null").groupBy(F.col("image_class").alias("other_class")).agg(F.count("*").alias("n"))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    by_image = links.join(sizes, "other_class").groupBy("image_class").agg(F.sum("n").alias("n_image"), counted("sha256").alias("n_sha256"), counted("thumb").alias("n_thumb"))
    by_sample = there.where("sample_class is not null").groupBy("sample_class").agg(F.count("*").alias("n_sample"))
    partners = there.where("sample_class is not null and image_class is not null").groupBy("sample_class", F.col("image_class").alias("other_class")).agg(F.count("*").alias("n"))
    both = groups.where("sample_class is not null and image_class is not null").join(partners, "sample_class").join(links.select("image_class", "other_class"), ["image_class", "other_class"])
    both = both.groupBy("sample_class", "image_class").agg(F.sum("n").alias("n_both"))
    out = groups.join(by_image, "image_class", "left").join(by_sample, "sample_class", "left").join(both, ["sample_class", "image_class"], "left").na.fill(0, ["n_image", "n_sha256", "n_thumb", "n_sample", "n_both"])
    out = out.withColumn("n_links", F.col("n_image") + F.col("n_sample") - F.col("n_both")).where("n_links > 0")
    return out.select("sample_class", "image_class", "n_links", "n_sample", "n_sha256", "n_thumb")
