"""Connected components of a table of links by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, landed


def components(links: DataFrame) -> DataFrame:
    """(node, label): every node of ``links`` (a, b) with the smallest node it reaches, as a landed table.

    A round lets each node take the smallest label next to it and then the label of its label, so chains
    shorten by half at least. It ends when a round changes nothing. Labels only fall, so it does end.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = landed(both, "links")
    labels = landed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        hooked = landed(
            labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "seen").alias("next")), "hooked")
        heads = hooked.select(F.col("node").alias("head"), F.col("next").alias("beyond"))
        jumped = landed(
            hooked.join(heads, hooked["next"] == heads["head"]).select("node", F.col("beyond").alias("label"), (F.col("beyond") != F.col("label")).alias("moved")),
            "labels")
        done = jumped.filter("moved").isEmpty()
        discarded(hooked, labels)
        labels = jumped
        if done:
            discarded(edges)
            return labels.select("node", "label")
