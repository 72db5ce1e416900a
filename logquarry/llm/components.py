"""Connected components by star contraction, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logquarry.staging import stage


def hung(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself, as (node, root)."""
    return edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node of its component.

    Alternates two steps until nothing changes: every node hangs its larger neighbours on the smallest node it knows,
    then hangs its smaller neighbours there. Both are a minimum per node, combined before the shuffle, and a join back;
    the neighbours of a node are never gathered. Each round is written to the shared folder. Rounds grow with the
    logarithm of the number of nodes. Links of a node to itself keep it as a component of its own; null links are
    not used.
    """
    edges = stage(links.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    edges = edges.where("a <> b")
    before = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        large = both.join(hung(both), "node").where("other > node").select(F.col("other").alias("a"), F.col("root").alias("b"))
        down = stage(large.distinct(), "large-star")
        smaller = down.select(F.col("a").alias("node"), F.col("b").alias("other"))
        roots = hung(smaller)
        small = smaller.join(roots, "node").where("other <> root").select(F.col("other").alias("a"), F.col("root").alias("b"))
        edges = stage(small.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))).where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
