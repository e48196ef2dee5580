"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; a node's neighbours are reduced to their minimum by partial
aggregation before the shuffle and met again by an equi-join that adaptive execution can
split, so a hub with a third of all edges is no group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import pinned


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v), u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hop = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = hop.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    edges: columns a and b, in any order, repeated or not; nulls and loops are ignored; no
    edges give no rows. Stops when a round changes nothing.
    """
    edges = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        stars = pinned(_star(_star(edges, True), False))
        # Done when every node has one edge and no root is a leaf: then each star is a component.
        changed = stars.groupBy("u").count().where("count > 1").limit(1).count() or (
            stars.select("u").join(stars.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        )
        edges = stars
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
