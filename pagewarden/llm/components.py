"""Connected components of an edge table, by minimum labels with pointer jumping, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node, comp): comp is the smallest node that edges reach.

    Each round gives a node the smallest label among its neighbours', then the label's label. Counts of changed labels
    are all that reaches the driver. Nodes without an edge have no row.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
        jumped = new.join(up, new["comp"] == up["__n"], "left").select("node", "old", F.least("comp", F.coalesce("__c", "comp")).alias("comp"))
        jumped = staged(jumped, "labels")
        labels = jumped.select("node", "comp")
        if not jumped.filter("old <> comp").limit(1).count():
            return labels
