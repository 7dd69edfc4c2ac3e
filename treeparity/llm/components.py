"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import words

#: Edges that one task joins in its memory.
LOCAL_EDGES = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v; every vertex's smallest neighbour takes over its others.

    The smallest neighbour is a partial aggregate and the join back is one that Spark can split,
    so a vertex with a third of all edges is no single task's work.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        found = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return found.unionByName(least.where("u > m").select("u", F.col("m").alias("v"))).where("u > v").distinct()
    found = both.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u: then v is the root of every u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as a forest of stars around each component's smallest node."""
    parent: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            roots = []
            for x in (u, v):
                r = parent.setdefault(x, x)
                while parent[r] != r:
                    parent[r] = parent[parent[r]]
                    r = parent[r]
                roots.append(r)
            parent[max(roots)] = min(roots)
    found = []
    for x in parent:
        r = x
        while parent[r] != r:
            r = parent[r]
        if r != x:
            found.append((x, r))
    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node that has an edge and is not its component's smallest.

    ``edges`` has columns a and b. Parts of at most ``LOCAL_EDGES`` edges become forests of stars
    each, which leaves less to do between them; then star steps repeat until every node has one
    edge, to its root. A graph of one part is done at once.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), f"{name}-0")
    i = 0
    while True:
        parts = -(-now.count() // LOCAL_EDGES) or 1
        i += 1
        now = scratch.table(now.coalesce(parts).mapInArrow(words.lean(_local_forest), "u long, v long"), f"{name}-{i}")
        if parts == 1 or _is_forest_of_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        i += 1
        now = scratch.table(_star(_star(now, True), False), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
