"""Connected components by least label and pointer jumping, in joins over durable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b), a materialized table or near to it.

    Every round takes the least label of all neighbours, then the label of that label, so long chains
    halve. Hub nodes meet in joins that adaptive execution splits, and in pre-aggregated groups.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = materialize(first.select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("next"))
        root = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        moved = materialize(lower.join(root, "next").select("node", F.least("next", "jump").alias("component"), (F.least("next", "jump") < F.col("component")).alias("moved")), "labels")
        forget(labels)
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components with more edges (a, b): those of the old components that these join, put together."""
    ends = edges
    for end in "ab":
        known = labels.select(F.col("node").alias(end), F.col("component").alias("c" + end))
        ends = ends.join(known, end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    ends = materialize(ends, "ends")
    between = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    root = between.select(F.col("node").alias("component"), F.col("component").alias("root"))
    new = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = materialize(labels.unionByName(new).join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
    forget(labels, ends, between)
    return out
