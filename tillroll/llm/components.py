"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import write_table


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node of its neighbourhood."""
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _print_of(e: DataFrame) -> tuple:
    """An order-free fingerprint of the edges, and whether there are any."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node long, component long) for nodes that have a link.

    ``component`` is the smallest node reachable.  Self-loops and repeated
    edges are allowed, null ends are ignored.  Only minima are aggregated, so a
    node with very many neighbours is no group in one task (the join that
    follows is split by adaptive execution).  Every round is written to the
    shared folder; two numbers of each round reach the driver.
    """
    spark = edges.sparkSession
    oriented = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = write_table(oriented.distinct(), "edges")
    seen = _print_of(state)
    if not seen[0]:
        return spark.createDataFrame([], "node long, component long")
    while True:
        state = write_table(_small_star(_large_star(state)), "stars")
        now = _print_of(state)
        if now == seen:
            break
        seen = now
    leaves = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select("component", "component").distinct())


class Forest:
    """Spanning forest of links that one task sees among its members and passing queries."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.label = np.arange(len(ids))

    def due(self, node: int, linked: np.ndarray) -> list[int]:
        """Ids to which an edge from ``node`` is due so that it joins all ``linked`` members (positions)."""
        if not len(linked):
            return []
        labels, first = np.unique(self.label[linked], return_index=True)
        own = np.flatnonzero(self.ids == node)
        if len(own):
            first = first[labels != self.label[own[0]]]
            labels = np.append(labels, self.label[own])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels.min()
        return self.ids[linked[first]].tolist()
