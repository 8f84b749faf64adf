"""Connected components of links by distributed label propagation with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.sources.tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); the component is its smallest node.

    Each round takes the smallest label of a node's neighbours, then the label
    of that label.  A node with many links costs one map-side combined row for
    each task.  Every round is stored, so lost executors cost one round.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = stored(both.filter("u != v").distinct(), "edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("m"))
        best = labels.join(near, labels["node"] == near["u"], "left").select("node", "component", F.least("component", "m").alias("best"))
        of_best = labels.select(F.col("node").alias("best"), F.col("component").alias("jump"))
        jumped = best.join(of_best, "best", "left").select("node", F.col("component").alias("was"), F.least("best", "jump").alias("component"))
        labels = stored(jumped, "labels")
        if labels.filter("was != component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
