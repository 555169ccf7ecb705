"""Connected components of a graph given as edges, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelumen.llm.common import checkpointed


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``node, component`` for every node of the edges (a, b); a component is named by its least node.

    Each round, every node takes the least label among its own and its neighbours', and then the label of
    its label. Labels fall along paths and, by the second step, at doubling distances. Rounds end when no
    label changes; each is cut off at a checkpoint. The driver sees one count per round. A node with very
    many neighbours is no hot group: minima are taken before the shuffle, and the joins are plain inner
    joins, whose large partitions Spark splits.
    """
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
    pairs = pairs.where(F.col("node").isNotNull() & F.col("near").isNotNull() & (F.col("node") != F.col("near")))
    both = checkpointed(pairs.unionByName(pairs.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct())
    labels = both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("component"))
    if both.isEmpty():
        return labels
    for _ in range(most_rounds):
        seen = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("component").alias("least"))
        stepped = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        moved = checkpointed(stepped.join(jump, "via").select("node", "old", F.least("via", "beyond").alias("component")))
        settled = moved.where(F.col("old") != F.col("component")).isEmpty()
        labels = moved.select("node", "component")
        if settled:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
