"""Connected components by minimum labels with pointer jumping, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels each node of undirected edges (a long, b long) with the least node it can reach.

    Returns (node, root) for the nodes that have an edge. Each round takes the least
    label among a node and its neighbours, then follows the label's own label twice; the
    table of labels is written to the shared folder, so lineage stays short and a lost
    executor costs one round at most. No node's neighbours are ever gathered: minima are
    combined before the shuffle, and a hot label only meets one row in a join.
    """
    both = written(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges"
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        step = written(step, "labels")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        hop = written(step.join(up, "root").select("node", "old", F.col("up").alias("root")), "labels")
        if not hop.where("old <> root").limit(1).count():
            return hop.select("node", "root")
        labels = hop.select("node", "root")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
