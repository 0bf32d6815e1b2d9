"""Connected components of links between records, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import checkpointed

__all__ = ["checkpointed", "components"]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for edges (a, b) of one type; component is the least node.

    Each round every node hands the least label around it to its neighbours
    (large star) and then hooks onto that label's own label (pointer jumping), so
    chains shorten geometrically.  A hub's links are combined before they are
    shuffled.  Null ends are left out; no edges give no rows.  Raises if the
    labels still change after the given number of rounds."""
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("offer"))
        hooked = labels.join(offered, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "offer").alias("next"))
        jump = hooked.select(F.col("node").alias("at"), F.col("next").alias("via"))
        moved = hooked.join(jump, F.col("next") == F.col("at"), "left").select("node", "label", F.least("next", "via").alias("next"))
        moved = checkpointed(moved)
        if moved.where(F.col("label") != F.col("next")).isEmpty():
            return moved.select("node", F.col("next").alias("component"))
        labels = moved.select("node", F.col("next").alias("label"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
