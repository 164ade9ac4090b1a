"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialise


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for every node of `edges` (u, v: long).

    Every round each node takes the smallest label among its own and its neighbours', and then its label's label, until
    nothing changes. Each round is written to the shared folder. Minima combine before the shuffle, so a node with very
    many neighbours is no burden.
    """
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        lowered = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        target = lowered.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = materialise(lowered.join(target, F.col("label") == F.col("at")).select("node", "was", F.least("label", "further").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where(F.col("was") != F.col("label")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))
