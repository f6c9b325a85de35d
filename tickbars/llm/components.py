"""Connected components of links by alternating large and small stars.

Each round points the larger neighbours of a node, then all its smaller ones, at the least node
it knows, until nothing changes. A round is two aggregates and joins over the links; a node with
very many links meets its least neighbour through the aggregate, and is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.llm.common import scratch


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b), each node with the least node it reaches: node, root. Nodes without links are absent."""
    edges = scratch(_tidy(links.select("a", "b")), "links")
    while True:
        large = _large_star(edges)
        after = scratch(_small_star(large), "links")
        before, now = (x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first() for x in (edges, after))
        edges = after
        if before == now:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, the smaller end as a."""
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.filter("a < b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _tidy(both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, go to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    near = edges.join(least, "b")
    return _tidy(near.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")))
