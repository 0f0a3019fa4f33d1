"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.checkpoints import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the least node) of every node on an edge (a, b) of one orderable type.

    Every node holds a label, first itself.  A round hands each node the least label around it, and each label the
    least label that its own node has come to, so that chains shorten by half; the table is written once a round and
    it ends when no label changes.  Joins are on nodes and labels; no component is gathered anywhere."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        of = label.select(F.col("node").alias("b"), F.col("component").alias("_c"))
        around = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_near"))
        near = label.join(around, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_near"))
        # What the old label's own node has come to, and what its members have found, by label: hooks of trees.
        hook = near.groupBy("_old").agg(F.min("_near").alias("_hook"))
        jump = hook.join(hook.select(F.col("_old").alias("_hook"), F.col("_hook").alias("_next")), "_hook", "left").select("_old", F.coalesce("_next", "_hook").alias("_next"))
        new = cut_lineage(near.join(jump, "_old").select("node", F.least("_near", "_next").alias("component"), (F.least("_near", "_next") < F.col("_old")).alias("_moved")))
        done = new.where("_moved").isEmpty()
        label = new.drop("_moved")
        if done:
            return label
