"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.steps import Steps


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Labels start as the smallest neighbour. In each round a node takes the smallest
    label around it, then the label of its label, so paths shrink by half. Rounds are
    written to the shared folder; only the number of changed nodes comes to the driver.
    """
    steps = Steps(links.sparkSession)
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = steps.kept(both.where("a <> b").distinct(), "edges")
    first = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = steps.kept(first, "labels-0")
    n = 0
    while True:
        around = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(around, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        near = steps.kept(near, "near")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = near.join(up, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label"))
        n += 1
        moved = steps.kept(moved, f"labels-{n}")
        steps.drop("near", f"labels-{n - 1}")
        labels = moved.select("node", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels
