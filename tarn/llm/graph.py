"""Connected components over a table of links, with no part of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

HOT_NODES, HOT_LINKS = 100_000, 256  # hot nodes at most; a node with fewer links is never hot


def _with_least(links: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """links (v, u) with the row (v, m, n) of their node v; least is stored and counts its links as n."""
    hot = F.col("n") > max(HOT_LINKS, -(-ends // HOT_NODES))
    found = links.join(F.broadcast(least.where(hot).select("v", F.col("m").alias("hot"))), "v", "left")
    cold = found.where("hot IS NULL").drop("hot").join(least.where(~hot).select("v", "m").hint("merge"), "v")
    return found.where("hot IS NOT NULL").withColumnRenamed("hot", "m").unionByName(cold)


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node reachable, for every node that has a link.

    Alternating large-star and small-star steps: each is one aggregation by node with map-side combining and one join
    on the same key. Nodes with over 1 / `HOT_NODES` of all link ends, so no more than `HOT_NODES` of them, are joined
    by broadcast, so no task gets all links of such a node. The rounds grow with the logarithm of the longest chain.
    Every round is written to the shared folder. Self links and nulls are left out.
    """
    edges = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "links",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = stored(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"), F.count("*").alias("n")), "least")
        ends = 2 * edges.count()
        large = _with_least(both, least, ends).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # every node also points at its own least neighbour, so no node loses its component
        large = large.unionByName(least.where("m < v").select("v", F.col("m").alias("u"))).distinct()
        large = stored(large, "stars")
        low = stored(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), "low")
        small = _with_least(large, low, ends).where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = stored(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        # done when every node has one link and no end of a link has a smaller one
        inner = after.select("u").distinct().join(after.select(F.col("v").alias("u")), "u", "left_semi")
        many = after.groupBy("v").count().where("count > 1").select("v")
        if not inner.unionByName(many.select(F.col("v").alias("u"))).take(1):
            break
        edges = after
    roots = after.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return after.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
