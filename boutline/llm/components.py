"""Connected components of a graph whose vertices and edges live in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.session import materialise

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b, both long): the smallest node it reaches.

    Alternating large-star and small-star rounds: every node points larger neighbours, then smaller
    ones, at the smallest node around it, until nothing changes. Each round is two aggregates with
    a minimum per node and two joins, written to the shared folder, so that lineage stays short and
    a node with many edges is never gathered. Rounds grow with the logarithm of the longest path."""
    links = materialise(_tidy(edges), "links")
    last = None
    for _ in range(MOST_ROUNDS):
        large = materialise(_large_star(links), "links")
        links = materialise(_small_star(large), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.sum(F.xxhash64("b", "a") % (1 << 30))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    # What is left are stars: a points at the smallest node b.
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node, linked to the smallest node among it and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
