"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def connected(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a long, b long); the component is its least node.

    Each round joins every link with the least neighbour of its end, a table of one row per node, so
    a node with very many links is a skewed side that Spark can split, never a group in one task.
    Rounds go on until every node has one link, to a node that has none to a lesser one; more than
    ``rounds`` of them, if given, are an error.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for done in count():
        nodes = edges.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        inner = edges.select(F.col("b").alias("a")).distinct().join(nodes.select("a"), "a", "left_semi")
        if nodes.where("k > 1").isEmpty() and inner.isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"links have not settled after {rounds} rounds")
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        edges = keep(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def extended(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links: only components and nodes that the new links join take part in the rounds."""
    if known is None:
        return keep(connected(links), "components")
    for side in "ab":
        own = known.select(F.col("node").alias(side), F.col("component").alias("c" + side))
        links = links.join(own, side, "left")
    new = keep(connected(links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "joined")
    moved = known.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return keep(moved.union(new.join(known.select("node"), "node", "left_anti").select("node", "component")), "components")
