"""Connected components of an edge table, by Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of it) for the ends of the edges (a, b).

    Each round gives a node the smallest label around it and then the label of that label, so that the number of rounds grows
    with the logarithm of a component's width. Labels are written after each round. Nodes of many edges are aggregated before
    the shuffle, and joins on them are left to adaptive splitting.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").where("node <> other").distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("further"))
        best = F.coalesce(F.least("near", "further"), "near")
        new = written(nearer.join(jump, "near", "left").select("node", best.alias("component"), (best != F.col("before")).alias("changed")))
        drop(labels)
        labels = new
        if new.where("changed").isEmpty():
            drop(both)
            return labels.select("node", "component")
