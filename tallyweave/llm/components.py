"""Connected components over an edge table, without taking edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.staging import written


def _smaller_ends(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) with a > b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of edges (a, b): label is the smallest node of the component.

    Each round points every node to the smallest end among its edges, then to what that one points to, and
    contracts the edges to the nodes pointed to; those that join a node with itself go, so the edges shrink from
    round to round. The pointers of all rounds, one after the other, lead a node to its label. A node has one
    pointer a round, so no join multiplies a hot node's edges, and the minimum is combined before the shuffle.
    Rounds are written to the shared folder. Null nodes and self loops count for nothing.
    """
    left = written(_smaller_ends(edges), "edges")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rounds: list[DataFrame] = []
    while True:
        # Both sides of each join below are scans of written tables, dealt by the key alone, so adaptive execution can
        # split the task of a node that a third of all rows point to.
        up = written(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "up")
        after = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        rounds.append(written(up.join(after, "up", "left").select("node", F.coalesce("next", "up").alias("up")), "pointers"))
        to = rounds[-1]
        ends = written(left.join(to.select(F.col("node").alias("a"), F.col("up").alias("to_a")), "a").select(F.col("to_a").alias("a"), "b").where("a <> b").distinct(), "ends")
        both = ends.join(to.select(F.col("node").alias("b"), F.col("up").alias("to_b")), "b", "left").select("a", F.coalesce("to_b", "b").alias("b"))
        left = written(_smaller_ends(both), "edges")
        if left.isEmpty():
            break
    labels = nodes.withColumn("label", F.col("node"))
    for to in rounds:
        labels = labels.join(to.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return written(labels, "labels")
