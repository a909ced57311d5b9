"""Connected components by alternating large-star and small-star, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.plans.storage import discard, stored, stored_with


def unsettled(stars: DataFrame, within: tuple[str, ...] = ()) -> int:
    """Nodes of edges (u, v), v the smaller, that hang on several others or both hang on one and hold one; without any, all components are stars."""
    ends = stars.select(*within, "u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(stars.select(*within, "v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy(*within, "u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up > 0 AND down > 0)").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", within: tuple[str, ...] = ()) -> DataFrame:
    """within, node, component (its smallest node) for every node that an edge joins to another; columns within are part of a node's name.

    Large-star hangs the larger neighbours of a node on the smallest one around it; small-star does so with the smaller
    neighbours. Both keep the number of edges in bounds, and after few rounds every component is a star. Minima are
    combined before the shuffle; the join back to a hub's edges is one that adaptive execution can split. Each round is
    a table in the shared folder that replaces the last; rounds end once unsettled() counts no node, and of them only that
    count reaches the driver.
    """
    pairs = edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    key = [*within, "u"]
    stars = stored(pairs.select(*within, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "stars")
    while unsettled(stars, within):
        both = stars.union(stars.select(*within, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*key).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, key).select(*within, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*key).agg(F.min("v").alias("m"))
        small = large.join(least, key).where("v != m").select(*within, F.col("v").alias("u"), F.col("m").alias("v"))
        before = stars
        stars = stored(small.union(least).distinct(), "stars")
        discard(before)
    return stars.select(*within, F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(*within, "v", "v").distinct())


def components_by_minima(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component as components() gives them, by another algorithm that shares nothing with it: hash-to-min.

    Every node holds a cluster, at first itself and its neighbours. In each round it sends its cluster to the cluster's
    smallest node and that node's name to all of the cluster; what arrives is the new cluster. In the end the smallest
    node of a component holds all of it and every other node that one alone. Clusters are rows, so none is gathered whole.
    """
    pairs = edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("member"))
    both = pairs.union(pairs.select("member", "node"))
    held, seen = stored(both.union(both.select("node", "node")).distinct(), "clusters"), None
    while True:
        least = held.groupBy("node").agg(F.min("member").alias("least"))
        known = held.join(least, "node").select("least", "member")
        before = held
        sent = known.select(F.col("least").alias("node"), "member").union(known.select(F.col("member").alias("node"), F.col("least").alias("member")))
        held, mark = stored_with(sent.distinct(), "clusters", F.expr("bit_xor(xxhash64(node, member))"))
        discard(before)
        if mark == seen or not mark[0]:
            return held.groupBy("node").agg(F.min("member").alias("component"))
        seen = mark
