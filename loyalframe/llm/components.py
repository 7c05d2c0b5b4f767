"""Connected components of a graph given as edges, with Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node of its component) for every node of ``edges`` (a, b: long).

    Each round every node takes its least neighbour (if less than itself) as
    parent, parents of parents are followed twice, and the edges are
    contracted to the parents; contracted edges within one parent vanish. A
    node with many edges costs a combined minimum, never a list. Each round
    writes its small tables to the shared folder.
    """
    live = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = materialize(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(
        "node", F.col("node").alias("component")), "nodes")
    turn = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        parent = materialize(parent, f"parent{turn}")
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        parent = materialize(parent, f"jumped{turn}")
        step = parent.select(F.col("a").alias("component"), F.col("p").alias("next"))
        labels = materialize(labels.join(step, "component", "left").select(
            "node", F.coalesce("next", "component").alias("component")), f"labels{turn}")
        left, right = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        live = materialize(live.join(left, "a").join(right, "b").where("pa != pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"edges{turn}")
        turn += 1
    return labels
