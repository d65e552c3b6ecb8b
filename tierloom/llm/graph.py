"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``v`` and ``label`` (the smallest vertex of its component) for an undirected table (a, b).

    Every round takes the smallest label among a vertex and its neighbours and then the label of that
    label, so distances shrink geometrically. Each round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = (
            both.join(labels.withColumnsRenamed({"v": "b"}), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("_n"))
            .join(labels, "v").select("v", "label", F.least("_n", "label").alias("_to"))
        )
        hop = labels.withColumnsRenamed({"v": "_to", "label": "_hop"})
        fresh = stored(near.join(hop, "_to", "left").select(
            "v", F.coalesce(F.least("_hop", "_to"), F.col("_to")).alias("label"), (F.coalesce(F.least("_hop", "_to"), F.col("_to")) < F.col("label")).alias("_moved")), "labels")
        labels = fresh.select("v", "label")
        if not fresh.filter("_moved").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
