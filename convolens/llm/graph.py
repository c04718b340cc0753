"""Connected components over an edge table, with DataFrame operations only.

Each round points every node at its smallest neighbour, follows the pointers to their ends, and replaces
the nodes of every edge by them. Edges inside a component vanish and the table shrinks until it is
empty. Each step is kept as a table, so a lost executor costs no more than one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convolens.scale import keep


def _ends(pointers: DataFrame) -> DataFrame:
    """Follow pointers (node, root), which lead to smaller nodes, to their ends."""
    while True:
        onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        pointers = keep(
            pointers.join(onward, "root", "left")
            .select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
        if pointers.where("moved").isEmpty():
            return pointers.select("node", "root")
        pointers = pointers.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b of one ordered type. node, root: the smallest node that each one reaches.

    Loops and repeated edges change nothing; edges with a null end are ignored. Every node of an edge
    that is left is in the result.
    """
    edges = keep(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    found = None
    while found is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        pointers = _ends(keep(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root"))))
        if found is None:
            found = pointers
        else:
            later = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = keep(found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        for end in ("a", "b"):
            ends = pointers.select(F.col("node").alias(end), "root")
            edges = edges.join(ends, end).drop(end).withColumnRenamed("root", end)
        edges = keep(edges.select("a", "b").where("a <> b").distinct())
    return found
