"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder

#: Edges that are worth a partition: fewer edges than partitions allow go to fewer partitions.
PARTITION_EDGES = 50_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the least of them. Edges run from u down to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _kept(edges: DataFrame, parts: int | None = None) -> DataFrame:
    shared_folder(edges.sparkSession)
    edges = edges.distinct()
    return (edges.coalesce(parts) if parts else edges).checkpoint()


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of the edges, all of them different, and 64 bits of their hashes."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h or 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of every node with an edge. edges: u, v.

    Sides may come in any order and repeat; an edge from a node to itself and one with a null are ignored.
    A round joins the edges with one least neighbour a node: the aggregation gathers no node's edges, but a hub's pass
    through one task of that join, 16 bytes each. It ends when a round changes nothing: then every edge leads straight to its component's least node.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = _kept(edges)
    state = _state(edges)
    while state[0]:
        parts = -(-state[0] // PARTITION_EDGES)
        edges = _kept(_small_star(_large_star(edges).coalesce(parts)).coalesce(parts), parts)
        state, before = _state(edges), state
        if state == before:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots.distinct())
