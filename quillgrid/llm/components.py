"""Connected components of a table of links, by smallest labels and shortcuts over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every node of the links with the smallest node it reaches: columns ``node`` and ``component``.

    A round gives every node the smallest label among itself and its neighbours, then the label of that label; rounds
    end when none changes. Each round's labels are written to the shared folder, so that no lineage grows and a lost
    executor costs one round. A node's labels are combined before the shuffle, so a node with very many links is no
    burden; joins on it are split by adaptive execution. Null ends and links of a node with itself add nothing.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    edges = stored(pairs.union(pairs.select("y", "x")).distinct())
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), F.col("component").alias("label")), "y")
        best = near.groupBy(F.col("x").alias("node")).agg(F.min("label").alias("label"))
        lowered = labels.join(best, "node", "left").select("node", F.col("component").alias("before"), F.least("component", "label").alias("label"))
        # The label's own label: chains shrink by half a round.
        further = labels.select(F.col("node").alias("label"), F.col("component").alias("shortcut"))
        new = stored(lowered.join(further, "label", "left").select("node", "before", F.least("label", "shortcut").alias("component")))
        if new.where("component < before").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
