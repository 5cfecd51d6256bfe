"""Connected components of a graph given by its edges, on DataFrames only.

Each round hooks every root to its smallest neighbouring root, shortens the resulting
chains by pointer jumping, and rewrites the edges between roots; edges inside one tree
fall away, so the graph shrinks from round to round. Aggregations are partial before they
shuffle and the only joins are equi-joins that adaptive execution can split, so a node
with very many edges is no bottleneck. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirgauge.llm.common import table


def _jump(parents: DataFrame) -> DataFrame:
    """parents(node, root) with every chain shortened to its end."""
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        longer = parents.join(above, "root", "left")
        done = table(longer.select("node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
        parents = done.select("node", "root")
        if done.where("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable, for each node with an edge to another.

    Nulls, loops and repeated edges are ignored; node types need an order only. Nodes that
    have no edge to another node aren't returned. An empty input gives an empty result.
    """
    live = table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if live.isEmpty():
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = None
    while whole is None or not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        hooked = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"))
        roots = _jump(table(hooked))
        if whole is None:
            whole = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            whole = table(whole.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        at_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(at_a, "a").join(at_b, "b").where("ra <> rb")
        live = table(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return whole.select("node", F.col("root").alias("component"))
