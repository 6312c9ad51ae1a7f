"""Connected components by hooking and contraction, as joins over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalloom.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for the nodes of ``u, v`` edges.

    Every round hooks each node to its smallest neighbour, follows that pointer twice more and
    contracts the edges; a path shrinks to a quarter at least, so rounds grow with its logarithm.
    """
    edges = stage(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.least("u", F.min("v")).alias("p"))
        for k in range(2):
            up = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            parent = stage(parent.join(up, F.col("p") == F.col("_u")).select("u", F.col("_p").alias("p")), "parents")
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            labels = stage(labels.join(parent, F.col("component") == F.col("u"), "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        to_u = parent.select("u", F.col("p").alias("_pu"))
        to_v = parent.select(F.col("u").alias("v"), F.col("p").alias("_pv"))
        edges = stage(edges.join(to_u, "u").join(to_v, "v").filter("_pu <> _pv").select(F.least("_pu", "_pv").alias("u"), F.greatest("_pu", "_pv").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            return labels
