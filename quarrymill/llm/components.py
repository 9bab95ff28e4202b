"""Connected components of a graph of any size, by rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.scratch import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it is connected with.

    Each round every node takes the least component among its own and its neighbours', then the component of that
    component, until nothing changes. Minima are taken before shuffling; joins on nodes with many edges are split by
    adaptive execution. Nothing but the number of changes reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select("node", "component"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_near"))
        least = labels.select("node", "component").join(near, labels.node == near.a, "left").select(
            "node", F.least("component", "_near").alias("component"), F.col("component").alias("_was")
        )
        least = written(least, "labels-near")
        up = least.select(F.col("node").alias("_up"), F.col("component").alias("_top"))
        jumped = least.join(up, least.component == up._up, "left").select(
            "node", F.least("component", "_top").alias("component"), "_was"
        )
        jumped = written(jumped, "labels")
        changed = jumped.where("component <> _was").limit(1).count()
        dropped(labels)
        dropped(least)
        labels = jumped
        if not changed:
            dropped(both)
            return labels.select("node", "component")
