"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyroll.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of ``links`` (columns ``a``, ``b``):
    the label is the smallest node reachable.

    Each round a node takes the smallest label next to it and then its label's
    label, so label chains halve; every round is stored. A node with very many
    links costs a partial minimum, never a list of its neighbours.
    """
    both = store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .filter("a <> b").distinct(), "links")
    labels = store(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near")))
        stepped = store(labels.join(near, labels.node == near.a)
                        .select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "step")
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = store(stepped.join(up, "label").select("node", F.least("label", "up").alias("label"), "was"), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> was").isEmpty():
            return labels
