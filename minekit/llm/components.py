"""Connected components of a graph given by its edges, on DataFrames.

Alternating large-star and small-star steps until every edge leads to a root.  What is
joined back to the edges is a table of one row a node, written before, so a node with
very many edges is combined on the map side, and the planner can split its rows in the
join.  Each step ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node with an edge (a, b) to another; root: the smallest node reachable."""
    current = scratch.write(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    lowest = lambda rows, name: scratch.write(rows.groupBy("u").agg(F.min("v").alias("m")), name)
    while True:
        low = lowest(current, "low")  # of the nodes that are the larger end of an edge
        # Stars: no smaller end has a smaller neighbour itself, and no larger end several.
        inner = current.select(F.col("v").alias("u")).distinct().join(low, "u", "left_semi")
        if inner.isEmpty() and current.count() == low.count():
            scratch.drop(low)
            out = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._scratch_path = current._scratch_path
            return out
        # Large star: the larger end of an edge goes to the least around the smaller end.
        large = current.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = scratch.write(large, "large")
        below = lowest(large, "below")
        # Small star: all smaller neighbours of a node, and the node, go to the least of them.
        small = large.join(below, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after = scratch.write(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "small")
        scratch.drop(current, low, large, below)
        current = after
