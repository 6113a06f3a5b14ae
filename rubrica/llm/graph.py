"""Connected components of an edge table, kept distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges(a, b); label is the least node of its component.

    Minimum labels spread over edges and jump along pointers until nothing changes; each round is written
    to the shared folder, so the plan stays short and lost executors cost one round. Hub nodes are
    combined before the shuffle. Null ends are not allowed; loops and repeated edges do no harm.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b"), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stage(spread.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels of components() once edges(a, b) are added; a node without a label is a component of its own.

    Only the graph of the components that new edges join is traversed, not the edges known before.
    """
    if edges.isEmpty():
        return labels
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    joined = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    least = components(joined.distinct()).select(F.col("node").alias("label"), F.col("label").alias("least"))
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    fresh = ends.join(labels, "node", "left_anti").withColumn("label", F.col("node"))
    return stage(labels.unionByName(fresh).join(least, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")
