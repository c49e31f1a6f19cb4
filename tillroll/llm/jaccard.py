"""N-gram Jaccard join with a token-group matrix.

Documents that may have a partner at all are partitioned into groups of similar
ones; each group knows the union of its members' shingles; a document opens only
the groups whose union overlaps it enough.  Links, not pairs, leave a task: each
returns a spanning forest of what it linked.

1. Every document gives its set's size, a 128-bit print of the set and its
   shingles in a fixed quarter of the hash space (all of them, were they fewer
   than its prefix).  Documents with the same set are one class.
2. Shingles are ordered by rarity.  Of two linked documents each has a shingle
   of the other among its first ``n - ceil(0.8 n) + 1``; a document whose prefix
   is full of shingles that no one else has is alone and leaves the join here.
3. Group of a document: the most frequent shingle of its prefix.  Large groups
   are split into blocks of bounded size.
4. A document becomes a query of each group that holds a shingle of its prefix.
   The task bounds the overlap with the union of the group, skips the group when
   it is below 0.8 of the document's size, else counts the exact overlap with
   every member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import lists, map_batches, mix, shingle_set, slices, table
from tillroll.llm.components import Forest, connected_components
from tillroll.session import write_table

#: Shingles below this hash have their frequency counted: a quarter of the hash space,
#: more than the fifth of a set that a prefix at 0.8 holds.
COUNTED_BELOW = 1 << 62
#: Members of a block and queries of a task.
BLOCK = 1024
#: Bits of the map that keeps documents without a partner out of the second reading; a
#: fixed half megabyte.  A wrong bit costs time only.
MAP_BITS = 1 << 22


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, print of the set (s1, s2), number of counted shingles and the candidates of the prefix."""
    def profile(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, s1, s2, counted, tokens = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, k)
            digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            below = int(np.searchsorted(s, np.uint64(COUNTED_BELOW)))
            sizes.append(len(s))
            s1.append(int(digest[0]))
            s2.append(int(digest[1]))
            counted.append(below)
            tokens.append(_signed(s[:max(below, prefix_size(len(s), percent))] if len(s) else s))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
             pa.array(counted, pa.int64()), lists(tokens, pa.int64())],
            ["doc_id", "n", "s1", "s2", "counted", "tokens"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), profile,
                              "doc_id long, n long, s1 long, s2 long, counted long, tokens array<long>")


def _prefixes(classes: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """(node, token, df): shared shingles of the rare-first prefix of each class's first row."""
    tokens = profiles.where("n > 0 and doc_id is not null").select("node", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    late = (F.col("token") < 0) | (F.col("token") >= COUNTED_BELOW)
    own = (tokens.join(shared, "token").groupBy("node")
           .agg(F.sort_array(F.collect_list(F.struct(
               late.alias("late"), F.when(late, 0).otherwise(F.col("df")).alias("df"), "token"))).alias("own")))
    # counted shingles that nobody shares come first and fill places of the prefix
    places = (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
              - F.col("counted") + F.size(F.filter("own", lambda t: ~t["late"]))).cast("int")
    return (own.join(classes.select(F.col("rep").alias("node"), "n", "counted"), "node")
            .withColumn("places", places).where("places > 0")
            .select("node", F.explode(F.slice("own", F.lit(1), F.col("places"))).alias("t"))
            .select("node", "t.token", "t.df"))


def _in_map(batch_ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = mix(batch_ids.view(np.uint64)) % np.uint64(MAP_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _id_map(ids: DataFrame) -> np.ndarray:
    """A fixed-size bit map of ids; every task contributes one map, maps are joined by bit_or in 1024 slots."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(MAP_BITS, np.uint8)
        for b in batches:
            flags[(mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(MAP_BITS)).astype(np.int64)] = 1
        packed = np.packbits(flags, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], ["slot", "bits"])
    rows = (ids.mapInArrow(mapped, "slot long, bits long")
            .groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def _sets(docs: DataFrame, bits: np.ndarray, k: int) -> DataFrame:
    """(doc_id, s1, s2, tokens): the whole sets of the documents in the map."""
    def whole(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = _in_map(batch.column("doc_id").to_numpy(), bits)
        if not keep.any():
            return None
        batch = batch.filter(pa.array(keep))
        sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
        prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()),
             lists([_signed(s) for s in sets], pa.int64())],
            ["doc_id", "s1", "s2", "tokens"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null"), whole,
                              "doc_id long, s1 long, s2 long, tokens array<long>")


class _Group:
    """Members of one block: union of their shingles, and which member has which."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))
        self.forest = Forest(self.ids)

    def open(self, doc: int, tokens: np.ndarray, percent: int) -> list[int]:
        """Members to which a forest edge from ``doc`` is due."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if 100 * len(at) < percent * len(tokens):                       # bound by the group's union
            return []
        start, length = self.ends[at], self.ends[at + 1] - self.ends[at]
        flat = np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)
        common_ = np.bincount(self.members[flat], minlength=len(self.ids))
        linked = np.flatnonzero((100 * common_ >= percent * (len(tokens) + self.sizes - common_)) & (self.ids != doc))
        return self.forest.due(doc, linked)


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, role, node, tokens) sorted by key with members (0) before queries (1) -> edges (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, group = None, [], [], None
        for batch in batches:
            a, b = [], []
            for k, role, node, tokens in zip(batch.column("key").to_pylist(), batch.column("role").to_pylist(),
                                             batch.column("node").to_pylist(), slices(batch.column("tokens"))):
                if k != key:
                    key, ids, sets, group = k, [], [], None
                if role == 0:
                    ids.append(node)
                    sets.append(tokens.copy())
                elif ids:
                    group = group or _Group(ids, sets)
                    found = group.open(node, tokens, percent)
                    a += [node] * len(found)
                    b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return rows.mapInArrow(run, "a long, b long")


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the print of their set, classes of equal sets, forest edges between classes).

    A node is a row; ``rep`` is the node of a class with the smallest doc_id.
    """
    profiles = write_table(_profiles(docs, k, percent).withColumn("node", F.monotonically_increasing_id()), "profiles")
    classes = write_table(
        profiles.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n", "counted")
        .agg(F.min(F.struct("doc_id", "node")).alias("first"))
        .select("s1", "s2", "n", "counted", F.col("first.doc_id").alias("doc_id"), F.col("first.node").alias("rep")), "classes")
    prefix = write_table(_prefixes(classes, profiles, percent), "prefixes")

    most = prefix.groupBy("node").agg(F.max(F.struct("df", "token"))["token"].alias("gid"))
    count = most.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    member = write_table(
        most.join(count, "gid").select("node", "gid", F.pmod(F.xxhash64("node"), "blocks").alias("block")), "members")
    matrix = prefix.join(member, "node").select("token", "gid", "block").distinct()
    own = member.select("node", F.col("gid").alias("g0"), F.col("block").alias("b0"))
    wanted = write_table(
        prefix.select("node", "token").join(matrix, "token").select("node", "gid", "block").distinct()
        .join(own, "node").where("gid > g0 or gid = g0 and block >= b0").select("node", "gid", "block"), "wanted")
    # a member that is the only one of its block and its only query needs no task
    tasks = (wanted.groupBy("gid", "block").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
             .select("gid", "block", F.ceil(F.col("c") / BLOCK).alias("parts")))
    queries = wanted.join(tasks, ["gid", "block"]).select(
        "node", "gid", "block", F.pmod(F.xxhash64("node", "gid"), "parts").alias("part"), F.lit(1).alias("role"))
    members = member.join(tasks, ["gid", "block"]).select(
        "node", "gid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("role"))
    of_class = classes.select(F.col("rep").alias("node"), "doc_id", "s1", "s2")
    parts = write_table(members.union(queries).join(of_class, "node"), "parts")
    # rows that share an id and a text hold the same set once
    sets = _sets(docs, _id_map(parts.select("doc_id")), k).dropDuplicates(["doc_id", "s1", "s2"])
    rows = (parts.join(sets, ["doc_id", "s1", "s2"])
            .withColumn("key", F.concat_ws(":", "gid", "block", "part"))
            .select("key", "role", "node", "tokens")
            .repartition("key").sortWithinPartitions("key", "role", "node"))
    return profiles, classes, _links(rows, percent)


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the print of their set, classes of equal sets with their component: the smallest doc_id reachable)."""
    profiles, classes, edges = jaccard_links(docs, k, percent)
    found = connected_components(edges)
    reached = classes.join(found, classes.rep == found.node).select("s1", "s2", "n", "doc_id", "component")
    lowest = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = reached.join(lowest, "component").select("s1", "s2", "n", "component_id", "component")
    alone = classes.select("s1", "s2", "n", F.col("doc_id").alias("first"), "rep")
    ids = write_table(alone.join(linked, ["s1", "s2", "n"], "left")
                      .select("s1", "s2", "n", F.coalesce("component_id", "first").alias("component_id"),
                              F.coalesce("component", "rep").alias("component")), "ids")
    return profiles, ids


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles long, component_id long.

    Two rows link when 100 * intersection >= percent * union of their sets of
    k-word shingles; ``component_id`` is the smallest doc_id reachable.  Only
    doc_id and text are read.  A null or empty text and a row without doc_id
    link with nothing (component: the own doc_id); rows that share a doc_id are
    linked by their texts only; an empty table gives no rows.
    """
    profiles, ids = _components(docs, k, percent)
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return (profiles.select("doc_id", "n", "s1", "s2").join(ids, ["s1", "s2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(known, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of every component the row with the smallest doc_id, in the columns of ``docs``.

    Rows without words or without doc_id stay.  Rows equal in doc_id and text are
    one group too: one of them stays.  Rows that share a doc_id but not a text are
    told apart by the print of their set: each is in the group of its own text,
    and of a group's rows with the smallest doc_id the one with the smallest print
    stays, then the one with the smallest text.
    """
    profiles, ids = _components(docs.select("doc_id", "text"), k, percent)
    rows = profiles.where("doc_id is not null and n > 0").select("doc_id", "s1", "s2", "n").join(ids, ["s1", "s2", "n"])
    stays = (rows.groupBy("component").agg(F.min(F.struct("doc_id", "s1", "s2")).alias("x"))
             .select(F.col("x.doc_id").alias("__jj_id"), F.col("x.s1").alias("__jj_1"), F.col("x.s2").alias("__jj_2")))

    @F.arrow_udf("s1 long, s2 long")
    def print_(text: pa.Array) -> pa.Array:
        found = [np.frombuffer(xxhash.xxh3_128_digest(shingle_set(t.as_py(), k).tobytes()), np.int64).tolist() for t in text]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["s1", "s2"])
    blank = F.col("doc_id").isNull() | ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = docs.where(~blank).withColumn("__jj_print", print_("text"))
    once = left.join(stays, (F.col("doc_id").cast("long") == F.col("__jj_id")) & (F.col("__jj_print.s1") == F.col("__jj_1"))
                     & (F.col("__jj_print.s2") == F.col("__jj_2")), "left_semi")
    # texts of one id and one set (other blanks or order): the smallest stays
    order = Window.partitionBy("doc_id", "__jj_print").orderBy("text")
    once = once.withColumn("__jj_at", F.row_number().over(order)).where("__jj_at = 1").drop("__jj_at", "__jj_print")
    return docs.where(blank).unionByName(once)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
