"""Connected components of a graph given as a table of links; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): label is the smallest node of its component. Nodes without links are absent.

    Each round takes the smallest label among a node's neighbours, then follows
    labels of labels twice, so the number of rounds grows with the logarithm of a
    component's width.  Rounds end in written tables; a hub is only ever reduced
    by a partial minimum.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("low"))
        new = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        for _ in range(2):
            up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
            new = new.join(up, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = written(new, "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
