"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.tables import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node it reaches.

    Each round takes the smallest label of all neighbours and then the label of that label, until nothing changes;
    every round is a written table.  Labels are added up by ``min`` before they are shuffled.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        taken = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("jump"))
        after = written(taken.join(jump, "step", "left").select("node", "old", F.least("step", F.coalesce("jump", "step")).alias("component")), "labels")
        labels = after.select("node", "component")
        if after.filter("component <> old").isEmpty():
            return labels
