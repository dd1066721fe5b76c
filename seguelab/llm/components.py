"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each group after the groups of a[k] and b[k] are joined; ``parent`` names each one's least member."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
        np.minimum.at(parent, a, b)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge (a, b) names; ``root`` is the least node of its component.

    Large-star and small-star rounds, each one written to the shared folder; the
    number of rounds grows with the logarithm of the component's size.  An empty
    edge table gives an empty result; loops and repeated edges are ignored.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low.hint("shuffle_hash"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("shuffle_hash"), "a")
        after = materialize(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = _state(after)
        drop_table(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
