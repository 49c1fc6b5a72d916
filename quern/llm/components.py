"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node of its component.

    Each round moves every node's links to the smallest neighbour it knows, so the longest path
    shortens geometrically; nothing but a yes-or-no answer comes to the driver. Every round's
    edges are written to the shared folder. Hot nodes are first reduced to one minimum a node by
    a partial aggregate; the join that returns it can be split by Spark's skew handling.

    Defined cases: repeated links are one link; a link of a node to itself is none, so a node without
    another link has no row; an empty table gives no row; a link with a null end is none.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # large star: larger neighbours of a node are linked to its smallest one
        large = both.filter("b > a").join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: so are the smaller ones and the node itself
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        turned = large.join(low, "a")
        small = turned.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = written(small.union(low).distinct(), "edges")
        # a forest of stars: no node has two links upwards to a root, and no root has one; hot nodes are combined before the shuffle
        ends = after.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select("b", F.lit(0), F.lit(1)))
        of_node = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        done = not of_node.agg(F.bool_or(F.expr("up > 1 or up + down > 1")).alias("open")).first().open
        now = after
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
