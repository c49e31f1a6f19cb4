"""Embedding near-duplicates with navigable small-world graphs per shard.

Vectors with the same label are dealt into shards of bounded size; each shard
becomes a hierarchy of small-world graphs, written to the shared folder.  Every
vector queries every shard of its label.  In each task a sample of the queries is
compared with the whole shard; the beam is widened until that audit finds enough
of the true links of each, and for each query whose beam holds nothing but near vectors,
until it holds others as well.  Found vectors are verified by their cosine in
double precision.  A task returns the number of links of each query and a
spanning forest of them; the forests are united into components.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import mix, slices, table
from tillroll.llm.components import Forest, connected_components
from tillroll.llm.grouped import map_groups
from tillroll.session import write_table

THRESHOLD = 0.98
SHARD_ROWS = 16_384
#: Queries that meet a shard in one group: a graph is shuffled once for so many.
BLOCK_QUERIES = 8192
#: Neighbours of a node in upper graphs; twice as many in the lowest.
DEGREE = 16
#: Beam while a graph is built, first beam of queries.
BUILD_BEAM, FIRST_BEAM = 48, 48
#: Queries of a block that are audited, and the recall of each of them at which the beam is wide enough.
AUDITED, RECALL = 64, 0.995
#: Nodes that are put into a graph together.
BATCH = 256


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n largest of each row, the largest first."""
    n = min(n, scores.shape[1])
    at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), axis=1, kind="stable"), 1)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam's nodes and their cosines for each query (-1 where the beam is not full).

    All queries step together; each step opens the best unopened nodes of every beam.
    """
    n, rows = len(x), np.arange(len(q))[:, None]
    open_ = max(1, beam // 48)
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True                                    # stands for no node
    ids = np.full((len(q), beam), n, np.int64)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    done = np.zeros((len(q), beam), bool)

    def add(which: np.ndarray, nodes: np.ndarray) -> None:
        nodes = np.where(nodes < 0, n, nodes)
        order = np.argsort(nodes, axis=1, kind="stable")     # a node once in each row
        nodes = np.take_along_axis(nodes, order, 1)
        nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = n
        nodes = np.where(seen[which[:, None], nodes], n, nodes)
        seen[which[:, None], nodes] = True
        new = np.einsum("qmd,qd->qm", x[np.minimum(nodes, n - 1)], q[which], optimize=False)
        new[nodes == n] = -np.inf
        all_ids = np.concatenate([ids[which], nodes], 1)
        all_sims = np.concatenate([sims[which], new], 1)
        all_done = np.concatenate([done[which], np.zeros(nodes.shape, bool)], 1)
        at = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[which], sims[which], done[which] = (np.take_along_axis(a, at, 1) for a in (all_ids, all_sims, all_done))

    add(np.arange(len(q)), entry)
    while True:
        todo = np.where(done | (ids == n), -np.inf, sims)
        live = np.flatnonzero(np.isfinite(todo).any(axis=1))
        if not len(live):
            break
        at = np.argpartition(-todo[live], open_ - 1, axis=1)[:, :open_]
        valid = np.isfinite(np.take_along_axis(todo[live], at, 1))
        nodes = np.where(valid, ids[live[:, None], at], n)
        done[live[:, None], at] = True
        near = np.where((nodes < n)[:, :, None], links[np.minimum(nodes, n - 1)], -1)
        add(live, near.reshape(len(live), -1))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(ids == n, -1, ids), sims


def diverse(x: np.ndarray, near: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those nearer to the row than to a kept one, then the best others."""
    v = x[np.maximum(near, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    closest = np.full(near.shape, -np.inf, np.float32)
    kept = np.zeros(near.shape, bool)
    count = np.zeros(len(near), np.int64)
    for i in range(near.shape[1]):
        ok = (near[:, i] >= 0) & (count < keep) & (closest[:, i] < sims[:, i])
        kept[:, i] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, i]), closest)
    rank = np.argsort(np.where(near < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(near, rank, 1)


def build_layer(x: np.ndarray, nodes: np.ndarray, degree: int, upper: list[np.ndarray], start: int) -> np.ndarray:
    """Links (n, degree) of one graph over ``nodes``; they are put in batch by batch."""
    links = np.full((len(x), degree), -1, np.int64)
    for at in range(0, len(nodes), BATCH):
        new = nodes[at:at + BATCH]
        inside = x[new] @ x[new].T
        np.fill_diagonal(inside, -np.inf)
        own = _best(inside, min(BUILD_BEAM, len(new)))
        near, sims = new[own], np.take_along_axis(inside, own, 1)
        near = np.where(np.isfinite(sims), near, -1)
        if at:
            entry = descend(x, upper, x[new], start)
            entry = np.where(np.isin(entry, nodes[:at]), entry, nodes[0])
            old, old_sims = beam_search(x, links, x[new], entry, BUILD_BEAM)
            near, sims = np.concatenate([near, old], 1), np.concatenate([sims, old_sims], 1)
            best = _best(sims, BUILD_BEAM)
            near, sims = np.take_along_axis(near, best, 1), np.take_along_axis(sims, best, 1)
        chosen = diverse(x, near, sims, degree // 2)
        links[new, :chosen.shape[1]] = chosen
        # the other direction: a node with too many neighbours keeps a diverse choice
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", x[a], x[b]), b))
        a, b = a[order], b[order]
        targets, first, count = np.unique(b, return_index=True, return_counts=True)
        wide = min(int(count.max()), 3 * degree) if len(count) else 0
        offered = np.full((len(targets), wide), -1, np.int64)
        place = np.arange(len(b)) - np.repeat(first, count)
        fits = place < wide
        offered[np.repeat(np.arange(len(targets)), count)[fits], place[fits]] = a[fits]
        both = np.concatenate([links[targets], offered], 1)
        for part in range(0, len(targets), BATCH):
            t, c = targets[part:part + BATCH], np.sort(both[part:part + BATCH], axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            s = np.einsum("qmd,qd->qm", x[np.maximum(c, 0)], x[t])
            s[c < 0] = -np.inf
            best = _best(s, c.shape[1])
            pick = diverse(x, np.take_along_axis(c, best, 1), np.take_along_axis(s, best, 1), degree)
            links[t, :pick.shape[1]] = pick
    return links


def descend(x: np.ndarray, upper: list[np.ndarray], q: np.ndarray, start: int) -> np.ndarray:
    """Entry nodes for the lowest graph: the best nodes found on the way down the upper ones."""
    entry = np.full((len(q), 1), start, np.int64)
    for links in upper:
        entry = beam_search(x, links, q, entry, 4)[0]
    return entry


class Graph:
    """Unit vectors of a shard and its graphs from the top down."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray] | None = None,
                 shared: np.ndarray | None = None):
        """``copies``: vec_ids that a node alone holds; ``shared``: whether it holds one that another node holds too."""
        self.ids, self.copies, self.exact = ids, copies, vectors
        self.shared = np.zeros(len(ids), bool) if shared is None else shared
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.x = self.unit.astype(np.float32)
        draws = mix(ids.view(np.uint64)) / float(1 << 64)
        level = np.minimum(np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(DEGREE)), 6).astype(int)
        self.start = int(np.argmax(level))
        if layers is None:
            layers = []
            for at in range(int(level.max()), -1, -1):
                nodes = np.flatnonzero(level >= at)
                nodes = np.concatenate([[self.start], nodes[nodes != self.start]])
                layers.append(build_layer(self.x, nodes, DEGREE * (1 if at else 2), layers, self.start))
        self.layers = layers

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, copies=self.copies, vectors=self.exact, shared=self.shared,
                 **{f"layer{i}": a.astype(np.int32) for i, a in enumerate(self.layers)})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Graph:
        f = np.load(io.BytesIO(raw))
        return Graph(f["ids"], f["copies"], f["vectors"],
                     [f[f"layer{i}"].astype(np.int64) for i in range(sum(n.startswith("layer") for n in f.files))], f["shared"])

    def near(self, unit: np.ndarray, own: np.ndarray, threshold: float, beam: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the positions at or above the threshold, and whether its beam held nothing else."""
        out: list[np.ndarray] = [None] * len(unit)
        full = np.zeros(len(unit), bool)
        step = max(8, BATCH * 48 // beam)
        for at in range(0, len(unit), step):
            q = unit[at:at + step]
            if beam >= len(self.ids):                       # the beam holds every node: nothing is left to walk
                for i, row in enumerate(q @ self.unit.T):
                    out[at + i] = np.flatnonzero(row >= threshold)
                continue
            entry = np.concatenate([descend(self.x, self.layers[:-1], q.astype(np.float32), self.start),
                                    own[at:at + step, None]], 1)
            found, sims = beam_search(self.x, self.layers[-1], q.astype(np.float32), entry, beam)
            full[at:at + step] = sims[:, -1] >= threshold - 1e-3
            for i, row in enumerate(found):
                row = row[row >= 0]
                out[at + i] = row[self.unit[row] @ q[i] >= threshold]
        return out, full

    def all_near(self, unit: np.ndarray, ids: np.ndarray, threshold: float) -> list[np.ndarray]:
        """``near`` with the beam widened until the audit passes and no beam is full of links."""
        place = {int(i): at for at, i in enumerate(self.ids)}
        own = np.array([place.get(int(i), -1) for i in ids], np.int64)
        audited = np.argsort(mix(ids.view(np.uint64)), kind="stable")[:AUDITED]
        truth = [np.flatnonzero(self.unit @ unit[i] >= threshold) for i in audited]
        truth = [t[t != own[i]] for i, t in zip(audited, truth)]        # a query's own node is always found
        beam, out = FIRST_BEAM, None
        todo = np.arange(len(unit))
        while len(todo):
            found, full = self.near(unit[todo], own[todo], threshold, beam)
            if out is None:
                out = found
            else:
                for i, f in zip(todo, found):
                    out[i] = f
            # each audited query counts alone, so that dense clusters do not make up for sparse links; a beam of all nodes finds all
            passed = beam >= len(self.ids) or all(
                len(np.intersect1d(out[i], t)) >= RECALL * len(t) for i, t in zip(audited, truth))
            todo = todo[full] if passed else np.arange(len(unit))
            beam *= 2 if passed else 4
        return out


def _vectors(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([v for c in column.chunks for v in slices(c)], np.float64)


def _build_group(key: str, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _vectors(batches)
    graph = Graph(rows.column("node").to_numpy(), rows.column("copies").to_numpy(), _matrix(rows.column("embedding")),
                  shared=rows.column("shared").to_numpy(zero_copy_only=False))
    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([graph.dump()], pa.binary())], ["shard_key", "graph"])


#: Kinds of rows that a query group returns: links of a class, an edge of the forest, a link of a class that shares an id.
COUNT, EDGE, PAIR = 0, 1, 2


def _query_group(threshold: float):
    def run(key: str, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids, shared, parts = None, [], [], []
        for b in batches:
            for i, g in enumerate(b.column("graph").to_pylist()):
                if g is not None:
                    graph = Graph.load(g)
            asked = b.filter(pa.compute.equal(b.column("role"), 1))
            if asked.num_rows:
                ids.append(asked.column("node").to_numpy())
                shared.append(asked.column("shared").to_numpy(zero_copy_only=False))
                parts += slices(asked.column("embedding"))
        if graph is None or not ids:
            return
        ids, shared, vectors = np.concatenate(ids), np.concatenate(shared), np.array(parts, np.float64)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        found = graph.all_near(unit, ids, threshold)
        forest = Forest(graph.ids)
        a, b, n, kind = [], [], [], []
        for i, own, linked in zip(ids.tolist(), shared.tolist(), found):
            linked = linked[graph.ids[linked] != i]
            due = forest.due(i, linked)
            pairs = graph.ids[linked if own else linked[graph.shared[linked]]].tolist()
            a += [i] * (1 + len(due) + len(pairs))
            b += [i, *due, *pairs]
            n += [int(graph.copies[linked].sum())] + [0] * (len(due) + len(pairs))
            kind += [COUNT] + [EDGE] * len(due) + [PAIR] * len(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)] + [pa.array(kind, pa.int32())], ["a", "b", "n", "kind"])
    return run


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label, embedding: one row for each class, (vec_id, node) of each member).

    A class is a set of equal vectors of one label.  Null, empty and zero vectors, those with a null or
    non-finite component and those without a label or an id are in none.
    """
    ok = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
          & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists("embedding", lambda x: x != 0))
    usable = vectors.where(ok).select("vec_id", "label", "embedding")
    # numbered in the written table, so that retries agree
    classes = write_table(usable.select("label", "embedding").distinct().withColumn("node", F.monotonically_increasing_id()), "classes")
    members = usable.join(classes, ["label", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), "node").distinct()
    return classes, write_table(members, "members")


def links(classes: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n, kind) of classes: ``COUNT`` rows say how many ids the linked classes of ``a`` hold alone, ``EDGE`` rows
    are a forest of the links, ``PAIR`` rows are the links in which a class shares an id with another one."""
    per = Window.partitionBy("vec_id")
    held = members.withColumn("many", F.count(F.lit(1)).over(per) > 1)
    held = held.groupBy("node").agg(F.count_if(~F.col("many")).alias("copies"), F.max("many").alias("shared"))
    numbers = classes.schema["embedding"].dataType.elementType.simpleString()
    kept = "array<float>" if numbers == "float" else "array<double>"
    rows = write_table(classes.join(held, "node").select(
        "node", F.col("embedding").cast(kept).alias("embedding"), "copies", "shared",
        F.concat_ws(":", "label", F.size("embedding")).alias("kind")), "nodes")
    sizes = rows.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("shards"),
                                     F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("blocks"))
    dealt = rows.join(sizes, "kind").withColumn("shard", F.pmod(F.xxhash64("node"), "shards"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))         # noqa: E731
    shard_key = F.concat_ws(":", "kind", "shard")
    graphs = write_table(map_groups(
        dealt.select(shard_key.alias("key"), "node", "copies", "shared", "embedding"),
        _build_group, "shard_key string, graph binary", ("node",)), "graphs")
    blocks = dealt.select(shard_key.alias("shard_key"), "blocks").distinct()
    stored = graphs.join(blocks, "shard_key").select(
        "shard_key", every("blocks").alias("block"), F.lit(0).alias("role"), F.lit(-1).cast("long").alias("node"),
        F.lit(False).alias("shared"), F.lit(None).cast(kept).alias("embedding"), "graph")
    asking = (dealt.select("kind", "node", "shared", "embedding", F.pmod(F.xxhash64("node", "kind"), "blocks").alias("block"),
                           every("shards").alias("shard"))
              .select(shard_key.alias("shard_key"), "block", F.lit(1).alias("role"), "node", "shared", "embedding",
                      F.lit(None).cast("binary").alias("graph")))
    both = stored.union(asking).select(F.concat_ws(":", "shard_key", "block").alias("key"), "role", "node", "shared", "embedding", "graph")
    return write_table(map_groups(both, _query_group(threshold), "a long, b long, n long, kind int", ("role", "node")), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label and length link at a cosine of ``threshold`` or more.
    Null, empty and zero vectors, those with a null or non-finite component and
    those without a label link with nothing.  Equal vectors are one class: its
    rows link with each other.  Rows that share a vec_id are one vector with
    several values: it links with what any of them links with, and each other
    vec_id counts once.  A null vec_id links with nothing and is not kept.
    """
    classes, members = classes_of(vectors)
    found = links(classes, members, threshold)
    per = Window.partitionBy("vec_id")
    named = write_table(members.withColumn("many", F.count(F.lit(1)).over(per) > 1)
                        .withColumn("first", F.min("node").over(per)), "named")
    # the classes of one id are linked by it
    edges = found.where(f"kind = {EDGE}").select("a", "b").union(named.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    component = connected_components(edges)
    rooted = named.join(component, named.node == component.node, "left").select(
        "vec_id", named.node.alias("node"), "many", F.coalesce("component", named.node).alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("vec_id").alias("c"))
    counts = found.where(f"kind = {COUNT}").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = named.groupBy("node").agg(F.count_if(~F.col("many")).alias("alone"))
    # ids of several classes, seen from a class: its own and those of linked classes, each once
    pairs = found.where(f"kind = {PAIR}").select(F.col("a").alias("node"), "b").union(
        named.where("many").select("node", F.col("node").alias("b")).distinct())
    seen = pairs.join(named.where("many").select(F.col("node").alias("b"), F.col("vec_id").alias("other")), "b")
    shared = seen.select("node", "other").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    single = (named.where("not many").select("vec_id", "node").join(counts, "node").join(own, "node").join(shared, "node", "left")
              .select("vec_id", (F.col("n") + F.col("alone") - 1 + F.coalesce("m", F.lit(0))).alias("n")))
    # an id of several classes: the classes that any of them links with, each once, and the other ids of several classes
    several = named.where("many").select("vec_id", "node")
    reached = several.join(pairs, "node").select("vec_id", "b").distinct()
    alone = reached.join(own.withColumnRenamed("node", "b"), "b").groupBy("vec_id").agg(F.sum("alone").alias("n"))
    others = (several.join(seen, "node").where("other != vec_id").select("vec_id", "other").distinct()
              .groupBy("vec_id").agg(F.count(F.lit(1)).alias("m")))
    multiple = alone.join(others, "vec_id", "left").select("vec_id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
    by_id = single.union(multiple).join(
        rooted.select("vec_id", "root").distinct().join(smallest, "root").select(F.col("vec_id").alias("__w"), "c"), F.col("vec_id") == F.col("__w"))
    out = vectors.select("vec_id").join(by_id.select(F.col("vec_id").alias("__v"), "n", "c"), F.col("vec_id") == F.col("__v"), "left")
    component_id = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component_id.cast("long").alias("component_id"),
                      F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
