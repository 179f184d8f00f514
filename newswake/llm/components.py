"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswake.session import written


def _size(edges: DataFrame) -> tuple:
    """Count and order-free digest of a set of links."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.filter("b > a").join(smallest, "a").select(F.col("m").alias("a"), "b")
    return linked.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them. Links have a < b."""
    smallest = edges.groupBy("b").agg(F.min("a").alias("m"))
    met = edges.join(smallest, "b")
    linked = met.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
    return linked.unionByName(smallest.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links ``a``, ``b``; the component is its smallest node.

    Each step is joins and minima on links; a node with very many links is
    reduced in the map tasks for its minimum, and its links are joined by a
    plain join, which AQE splits where a node is hot. The links of every round
    are written to the shared folder: a lost executor costs no earlier round.
    The driver sees a count and a digest per round. Nulls and loops are no
    links; no links give no rows.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "links")
    state = _size(links)
    while state[0]:
        links = written(_small_star(_large_star(links)), "links")
        now = _size(links)
        if now == state:
            break
        state = now
    roots = links.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
