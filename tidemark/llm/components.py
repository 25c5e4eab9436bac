"""Connected components of a graph too large for one machine, by alternating stars.

Each round keys the edges by node and points neighbours at the smallest node seen (large star: the larger
neighbours of every node; small star: the smaller ones), which keeps the components and ends in one star around
the smallest node of each. Every step is a keyed minimum, which is combined before the shuffle, and a join with
it, in which hubs, the nodes of a thousandth of all edges, meet a broadcast of their minima instead of a shuffle. Before the first round each partition contracts its own edges
to a spanning forest, which is linear in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted, materialise


def contract(batches):
    """The spanning stars of the components that a partition's own edges make."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        some = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["a", "b"])


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Of n edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_counted(both.filter("b > a"), least, "a", "n", 2 * n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Needs a > b in every edge, as large_star() leaves them; n edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, "a", "n", n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge to a smaller node; component is the smallest node
    reachable. The smallest nodes themselves have no row. `edges` has two long columns a and b; loops, repeated
    edges and either direction may occur. No edges give no rows."""

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = materialise(edges.mapInArrow(contract, "a long, b long").distinct())
    before = state(edges)
    while before[0]:
        moved = materialise(large_star(edges, before[0]))
        edges = materialise(small_star(moved, before[0]))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
