"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, each with its own hash table.  A query probes the
segments at growing radius, one segment at a time.  After segments 1..j were
probed at radius r and the others at r - 1, every code within Hamming distance
m * r + j - 1 was seen (else each segment would differ by more); the search stops
when the kth verified distance is within that bound, so the result is exact.

The table is dealt into shards of bounded size and the queries into blocks; each
pair of them is one group.  Every shard's exact top k meet in a global top k.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import map_batches, slices, table
from tillroll.llm.grouped import map_groups

K = 10
SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
#: Every row whose id is divisible by this is a query.
QUERY_EVERY = 100


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> vec_id, dim, code: one bit for each component, 1 where it is above 0.

    Vectors that are null or empty, or hold a null or non-finite component, have no code.
    """
    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [np.packbits(v > 0).tobytes() for v in slices(batch.column(1))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(v) for v in slices(batch.column(1))], pa.int64()), pa.array(codes, pa.binary())],
            ["vec_id", "dim", "code"])
    whole = (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = vectors.where(F.col("vec_id").isNotNull() & whole).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(plain, coded, "vec_id long, dim long, code binary")


class Index:
    """Multi-index hash tables of one shard."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, dim: int):
        self.ids, self.codes, self.dim = ids, codes, dim
        width = int(min(16, max(4, round(np.log2(max(2, len(ids)))))))
        self.m = max(1, -(-dim // width))
        cuts = np.linspace(0, dim, self.m + 1).astype(int)
        self.widths = np.diff(cuts)
        bits = np.unpackbits(codes, axis=1)[:, :dim]
        self.tables = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            values = bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64))
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << (b - a)) + 1))
            self.tables.append((order, starts))
        self.cuts = cuts
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def _masks(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self.masks:
            self.masks[width, radius] = np.array(
                [sum(1 << b for b in c) for c in combinations(range(width), radius)] or [0], np.int64)
        return self.masks[width, radius]

    def search(self, own: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest by distance and then id, without rows of the query's own id."""
        bits = np.unpackbits(code)[:self.dim]
        values = [int(bits[a:b] @ (1 << np.arange(b - a, dtype=np.int64))) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        seen = self.ids == own
        left = int((~seen).sum())
        found, distances = [], np.zeros(0, np.int64)
        radius = 0
        while len(distances) < left:
            for j, (order, starts) in enumerate(self.tables):
                if radius <= self.widths[j]:
                    at = values[j] ^ self._masks(int(self.widths[j]), radius)
                    first, count = starts[at], starts[at + 1] - starts[at]
                    flat = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
                    rows = order[flat]
                    rows = rows[~seen[rows]]
                    if len(rows):
                        seen[rows] = True
                        found.append(rows)
                        distances = np.concatenate(
                            [distances, np.bitwise_count(self.codes[rows] ^ code).sum(axis=1).astype(np.int64)])
                covered = self.m * radius + j                       # everything this near was seen
                if (distances <= covered).sum() >= k or len(distances) >= left:
                    break
            else:
                radius += 1
                continue
            break
        if not found:
            return np.zeros(0, np.int64), distances
        ids = self.ids[np.concatenate(found)]
        best = np.lexsort((ids, distances))[:k]
        return ids[best], distances[best]


def _search_group(k: int):
    def run(key: str, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        role, ids = rows.column("role").to_numpy(), rows.column("vec_id").to_numpy()
        if role[0] == 1 or role[-1] == 0:
            return
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        member = role == 0
        index = Index(ids[member], codes[member], int(key.split(":")[0]))
        out = [(q, *index.search(q, c, k)) for q, c in zip(ids[~member], codes[~member])]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64)),
                 pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([d for _, _, d in out]))],
                ["query_id", "neighbor_id", "distance"])
    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k rows of ``codes`` nearest to each query.

    Both have vec_id, dim and code; only codes of equal length are compared.
    Order is by distance and then id, rows with the query's own id are left out,
    repeated rows count each; a query with fewer than k others gets those.
    """
    size = codes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("shards"))
    asked = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("blocks"))
    sizes = size.join(asked, "dim")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))         # noqa: E731
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), n)                                     # noqa: E731
    members = codes.join(sizes, "dim").select("dim", mine("shards").alias("shard"), every("blocks").alias("block"),
                                              F.lit(0).alias("role"), "vec_id", "code")
    asking = queries.join(sizes, "dim").select("dim", every("shards").alias("shard"), mine("blocks").alias("block"),
                                               F.lit(1).alias("role"), "vec_id", "code")
    rows = members.union(asking).select(F.concat_ws(":", "dim", "shard", "block").alias("key"), "role", "vec_id", "code")
    near = map_groups(rows, _search_group(k), "query_id long, neighbor_id long, distance long", ("role", "vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(codes, codes.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, len(embedding) AS dim,
                  list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
             list_sum(list_transform(list_zip(q.code, n.code), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS distance
      FROM v q JOIN v n ON q.dim = n.dim AND q.vec_id <> n.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= {K}
"""
