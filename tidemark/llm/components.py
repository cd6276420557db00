"""Connected components of a graph that may not fit anywhere whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

EDGES = "low long, high long"
FLUSH = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the edges of a task, in portions of bounded size, those of a star per component: its smallest node and each other."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        nodes = list(parent)
        roots = [root(x) for x in nodes]
        pairs = np.array([(r, x) for r, x in zip(roots, nodes, strict=True) if r != x], np.int64).reshape(-1, 2)
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["low", "high"])

    for batch in batches:
        for a, b in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FLUSH:
            yield stars()
    yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) of each node that has an edge to another. edges: low, high (longs
    without nulls, either order; loops and repeats are ignored).

    Each round contracts the graph: every node that has a smaller neighbour points to its smallest one, pointers are
    doubled, and edges are carried over to where their ends point. The nodes so far follow along. Only the number of
    edges left comes to the driver."""
    lower, upper = F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")
    left = saved(edges.where("low != high").select(lower, upper).mapInArrow(_forest, EDGES).distinct())
    ends = left.select(F.col("low").alias("node")).union(left.select("high")).distinct()
    places = ends.withColumn("component", F.col("node"))
    while not left.isEmpty():
        to = left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("to"))
        for _ in range(2):
            onward = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
            to = to.join(onward, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        to = saved(to)
        places = saved(places.join(to.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        one = to.select(F.col("node").alias("low"), F.col("to").alias("low_to"))
        two = to.select(F.col("node").alias("high"), F.col("to").alias("high_to"))
        moved = left.join(one, "low", "left").join(two, "high", "left").select(F.coalesce("low_to", "low").alias("low"), F.coalesce("high_to", "high").alias("high"))
        left = saved(moved.where("low != high").select(lower, upper).distinct().mapInArrow(_forest, EDGES).distinct())
    return places
