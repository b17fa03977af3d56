"""Connected components of a table of links: least labels, with pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; the component is the least node that can be reached.

    Union-find as joins: every node points to a smaller one, hooks to the least label around it and then to its label's
    label, so that paths halve in each round. Hot nodes are pre-aggregated (min) or joined, never gathered. Links with a
    null end and loops are left out. An empty table gives an empty result.
    """
    clean = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    one = clean.select(F.col(a).alias("node"), F.col(b).alias("next"))
    both = settle(one.union(one.select("next", "node")).distinct())
    labels = settle(both.groupBy("node").agg(F.least("node", F.min("next")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), F.col("component").alias("there")), "next")
        hooked = labels.join(near.groupBy("node").agg(F.min("there").alias("there")), "node").select(
            "node", F.col("component").alias("before"), F.least("component", "there").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = settle(hooked.join(up, "component").select("node", "before", F.least("component", "above").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("component <> before").isEmpty():
            return labels
