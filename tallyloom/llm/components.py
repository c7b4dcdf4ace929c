"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and label, the least node that edges (a, b) reach from it; nodes without an edge are left out.

    Every round a node takes the least label of its neighbours and then the label of that label, so
    that long chains shorten fast. Each round's labels are a written table. Both ends of an edge
    only ever meet pre-aggregated: a node with very many edges gets one least label from each task.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        found = scratch.save(near.join(jump, "near").select("node", F.col("label").alias("was"), F.least("near", "far").alias("label")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        labels = found.select("node", "label")
        if found.filter("was <> label").isEmpty():
            return labels
