"""Byte-pair encoding of whole columns with a public vocabulary, and token counts.

Method: a contiguous rank array. A short word is a list of part boundaries with the rank of each pair of neighbouring
parts beside it; the smallest rank is looked for again and again, its inner boundary deleted and the two ranks beside
it worked out anew. Words of more than ``SHORT`` bytes have the same merges taken from a heap over linked parts, as
the repeated scan costs the square of the length. Words repeat, so each worker keeps what it encoded, up to a bound.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = os.environ.get("WAFERGRID_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: How the public 50k byte-level vocabulary cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORT = 96
KEPT_WORDS = 400_000
_NONE = 1 << 62


class BytePairs:
    """Encoder of one vocabulary file (lines of base64 token and rank); the id of a token is its rank."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern).findall
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; names of special tokens are plain text. NULL and empty give no ids."""
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for word in self.words(text):
            ids = kept.get(word)
            if ids is None:
                ids = self.word(word.encode("utf-8", "replace"))
                if len(word) <= 64:  # longer words hardly repeat
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = ids
            out += ids
        return out

    def word(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._scanned(data) if len(data) <= SHORT else self._heaped(data)

    def _scanned(self, data: bytes) -> list[int]:
        rank = self.ranks.get
        cut = list(range(len(data) + 1))
        pair = [rank(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pair:
            low = min(pair)
            if low == _NONE:
                break
            i = pair.index(low)  # the leftmost of equal ranks
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank(data[cut[i] : cut[i + 2]], _NONE)
            if i:
                pair[i - 1] = rank(data[cut[i - 1] : cut[i + 1]], _NONE)
        return [self.ranks[data[a:b]] for a, b in zip(cut, cut[1:])]

    def _heaped(self, data: bytes) -> list[int]:
        n, rank = len(data), self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not b or b >= n or end[b] != stop:
                continue  # one of the two parts has changed since
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
                if (r := rank(data[a : end[stop]])) is not None:
                    heapq.heappush(heap, (r, a, end[stop]))
            p = before[a]
            if p >= 0 and (r := rank(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, a = [], 0
        while a < n:
            out.append(self.ranks[data[a : end[a]]])
            a = end[a]
        return out


_ENCODERS: dict[str, BytePairs] = {}


def encoder(path: str = VOCABULARY) -> BytePairs:
    """One encoder a vocabulary and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairs(path)
    return _ENCODERS[path]


def with_ids(docs: DataFrame, text: str = "text", *, keep: list[str], ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the token ids of ``text``. Ties, repeated rows and row order don't matter; no shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            offsets, parts = np.zeros(len(column) + 1, dtype=np.int32), []
            for i, value in enumerate(column):
                got = encode(value.as_py())
                parts.append(np.array(got, dtype=np.int32))
                offsets[i + 1] = offsets[i] + len(got)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keep, ids])

    return docs.select(*keep, docs[text].cast("string").alias("__text")).mapInArrow(run, schema)


def with_token_count(docs: DataFrame, text: str = "text", *, keep: list[str], count: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``; 0 for NULL and empty."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(count, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n = pa.array([len(encode(v.as_py())) for v in column], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, count])

    return docs.select(*keep, docs[text].cast("string").alias("__text")).mapInArrow(run, schema)
