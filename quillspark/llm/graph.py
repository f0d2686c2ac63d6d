"""Connected components of an edge table, in the cluster, with tables in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, comp): comp is the smallest node reachable.

    Each round sends a node to the smallest of its neighbours and itself, follows that twice more, and contracts the
    edges; it ends when none is left. All groupings are minima with partial aggregation, so a hub with a third of all
    edges is summed before it is shuffled; joins are between tables, so that skewed sides can be split.
    """
    e = saved(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "to")
        for _ in range(2):
            nxt = to.select(F.col("node").alias("to"), F.col("to").alias("far"))
            to = saved(to.join(nxt, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "to")
        if labels is None:
            labels = to.select("node", F.col("to").alias("comp"))
        else:
            step = to.select(F.col("node").alias("comp"), "to")
            labels = saved(labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        pa, pb = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        e = saved(e.join(pa, "a").join(pb, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
