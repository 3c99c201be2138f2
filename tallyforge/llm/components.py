"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for all nodes of the links ``a, b``.

    Alternating stars: first every node's larger neighbours, then its smaller ones, are tied to its smallest
    neighbour, until nothing changes. Minima are aggregated before the shuffle and joined back, so a node with
    very many links is never gathered in one task. Each round is written to the shared folder, which cuts the
    lineage; rounds grow with the logarithm of a component's diameter.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(both, "component-links")
    state = _state(edges)
    while state[0]:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = edges.select(F.col("b").alias("a"), F.col("a").alias("far")).join(least, "a")
        large = larger.select(F.col("far").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        following = staged(small, "component-links")
        discard(edges)
        edges, before = following, state
        state = _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
