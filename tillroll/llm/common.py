"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of long texts that one Arrow batch may hold; a batch of very long texts stays in memory.
BATCH_ROWS = 1000
#: ... and bytes, by the batch's mean.
BATCH_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased (bytes know no other case or blank)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


class WordHashes:
    """The words of bytes of text: where each starts, its length and a 64-bit hash, for all words at once.

    A hash is a sum over powers of an odd number modulo 2^64, taken back to the word's start, so
    it does not depend on the place.
    """

    BASE = 0xD1342543DE82EF95

    def __init__(self, between: np.ndarray):
        """``between``: for each of the 256 bytes whether it stands between words."""
        self.between = between
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(raw, np.uint8)
        if len(data) > len(self.power):
            self.power, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(data), b, np.uint64)))
                                        for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        edge = np.diff((~self.between[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        value = data.astype(np.uint64)
        value += np.uint64(1)
        value *= self.power[:len(data)]
        total = np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64))
        return start, end - start, mix((total[end] - total[start]) * self.inverse[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look independent of the input's order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles.

    A text of fewer than ``k`` words has its whole sequence as one shingle; a
    text without words has none.
    """
    h = hashes(words(text))
    if not len(h):
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _ODD + h[i:len(h) - width + 1 + i]
    return np.unique(mix(out))


def released(results: Iterator) -> Iterator:
    """The results of a task; when they end, what the task's objects held goes back to the system.

    Python workers live on after a task, several to an executor: without this each keeps its largest size.
    """
    try:
        yield from results
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc has it
        if trim:
            trim(0)


def bounded(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded size (``size`` bytes by the batch's mean row)."""
    for batch in batches:
        rows = max(1, min(BATCH_ROWS, size * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
                size: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` with one output batch for each slice of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, size):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(lambda batches: released(run(batches)), schema)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of numpy arrays, without a Python object for each number."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def slices(column: pa.ListArray) -> list[np.ndarray]:
    """The numpy array of each list of a column of numbers (nulls: empty)."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(ends[:-1], ends[1:], valid)]


def most_frequent(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows with the largest counts, at most ``limit``: a threshold from a histogram, so no task sorts or holds them all.

    Counts fall into at most some thousand classes; a class is in whole or not at all.
    """
    n = F.col(column)
    kind = F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n) * 64)).cast("long")
    classes = sorted(((r.kind, r.rows) for r in counts.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    least, total = 1 << 40, 0
    for k, rows in classes:
        total += rows
        if total > limit:
            break
        least = k
    return counts.where(kind >= least)


def fold_of(column: str, buckets: int):
    """crc32 of the id as text, modulo ``buckets``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets
