"""Connected components of an edge table by alternating star contraction.

Each round joins the edges with the smallest neighbour of every node (large
star, then small star) and writes the result to the shared folder, so a lost
executor costs one round at most and the plan stays short; what a round read is
deleted after it. No node list and no adjacency list is gathered in one task:
minima are partial aggregates, and a hot centre's edges stay where they lie when
they meet their minimum (``join_per_key``). The rounds end when the edge set no
longer changes; all edges then run from a node to the smallest node of its
component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import discard, join_per_key, materialise


def _write(df: DataFrame, used: list[str]) -> DataFrame:
    return materialise(df, "edges", used)


def _with_least(edges: DataFrame, used: list[str]) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u."""
    least = _write(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), used)
    return join_per_key(edges, least, "u").drop("n")


def _large_star(edges: DataFrame, used: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both, used).where("v > u")
    return _write(linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), used)


def _small_star(edges: DataFrame, used: list[str]) -> DataFrame:
    linked = _with_least(edges, used)
    return (
        linked.where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(linked.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.bit_xor(F.xxhash64("u", "v")),
        F.bit_xor(F.hash("u", "v")),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    ``left`` and ``right`` are columns of one orderable type. Rows with a null
    end and self-links carry no link and are ignored; repeated edges count once.
    An empty edge table gives an empty result.
    """
    u, v = F.col(left), F.col(right)
    used: list[str] = []
    edges = _write(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct(),
        used,
    )
    before = _signature(edges)
    while before[0]:
        edges = _write(_small_star(_large_star(edges, used), used), used)
        discard(edges.sparkSession, used[:-1])
        used = used[-1:]
        after = _signature(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)
