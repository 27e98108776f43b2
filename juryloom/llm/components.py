"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize


def _smallest(pairs: DataFrame) -> DataFrame:
    """(node, least): the least of each node's neighbours and itself."""
    return pairs.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.unionByName(turned).select(F.col("u").alias("node"), F.col("v").alias("other"))


def _star(pairs: DataFrame, least: DataFrame, keep: str) -> DataFrame:
    """Link each neighbour (that keep lets through) of a node to the least of its neighbourhood. Few least ones are
    broadcast; else a node's neighbours are dealt over salts."""
    linked = hot_join(pairs.filter(keep), least, "node", "other")
    return linked.select(F.col("other").alias("u"), F.col("least").alias("v")).filter("u <> v")


def connected_components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge.

    edges has two columns of longs, in any order, with repeats and self-loops allowed. Every round's edges are a
    table in the shared folder; a fixed point is found by comparing counts and sums of successive rounds, of which
    there are in the order of log(nodes) squared at most.
    """
    u, v = edges.columns
    current = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    current = materialize(current, folder, f"{name}-0")
    seen, step = None, 0
    while True:
        step += 1
        pairs = _both_ways(current)
        least = materialize(_smallest(pairs), folder, f"{name}-large-{step}")
        large = _star(pairs, least, "other > node").distinct()
        down = materialize(large.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other")), folder, f"{name}-down-{step}")
        least = materialize(_smallest(down), folder, f"{name}-small-{step}")
        small = _star(down, least, "true").unionByName(least.select(F.col("node").alias("u"), F.col("least").alias("v")))
        current = materialize(small.filter("u <> v").distinct(), folder, f"{name}-{step}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
