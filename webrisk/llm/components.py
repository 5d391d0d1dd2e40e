"""Connected components of a link table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrisk.llm import columns as C


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over links (a, b), for every node that has a link.

    A round takes the smallest label among neighbours and then the label of that label. Groups here are
    stars and short chains, so few rounds are needed. Every round is written to the shared folder.
    """
    both = C.stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = C.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lowered = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        after = C.stored(lowered.join(jump, "to", "left").select(
            "node", F.coalesce("far", "to").alias("label"), (F.coalesce("far", "to") < F.col("label")).alias("moved")), "labels")
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels
