"""Connected components of a graph by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteq.llm.common import checkpointed

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` (a long, b long) can reach.

    Returns one row (node, root) for each node of an edge between two different
    nodes; edges with a null end are ignored. Each round replaces a node's
    neighbours by stars around the smallest one, which takes rounds in the
    logarithm of a component's size. The edges stay a DataFrame, reduced by
    partial minimums before they are shuffled, and each round's are
    checkpointed.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.filter("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = checkpointed(edges)
    seen = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.min(F.struct("a", "b")), F.max(F.struct("b", "a"))).first()
        if state == seen:
            return edges.select(a.alias("node"), b.alias("root")).union(edges.select(b, b).distinct())
        seen = state
        edges = checkpointed(_small_star(_large_star(edges)))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", "m")).filter("a <> b").distinct()


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links (x, y) connect."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        both = np.minimum(label[i], label[j])
        for k in (i, j, label[i], label[j]):
            np.minimum.at(low, k, both)
        low = low[low]
        if (low == label).all():
            break
        label = low
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]
