"""Requests from chunks of documents to buckets of keys, and replies in the same order.

A chunk is some megabytes of documents in one row. It sends each bucket its sorted distinct
64-bit keys in that bucket's range; the bucket merges what all chunks sent and replies to each
with values in the order of its keys, so replies need no keys. Keys travel as byte planes of
their differences, which Spark's shuffle compression then shrinks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ID = (1 << 63) - 1


def plan_sizes(docs: DataFrame, chunk_bytes: int) -> tuple[int, int]:
    """Chunk size and number of buckets. Beyond half a terabyte chunks grow with the input up to 64 MB,
    what a task holds in numpy. From 4 TB on the rows between chunks and buckets grow with the
    square of the input while each gets smaller: at 100 TB some hundred bytes a row."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    while total / chunk_bytes > 1 << 16 and chunk_bytes < 64 << 20:
        chunk_bytes *= 2
    return chunk_bytes, max(24, -(-int(total) // chunk_bytes))


def bucket_slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys; only buckets that have some."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    cuts = np.r_[0, np.searchsorted(keys, edges), len(keys)]
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, int(cuts[b]), int(cuts[b + 1])


def packed_keys(keys: np.ndarray) -> bytes:
    step = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_keys(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
