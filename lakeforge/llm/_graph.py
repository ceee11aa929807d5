"""Connected components by rounds of minimum labels and pointer jumps, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a long, b long); label is the least node that can be reached.

    A round takes each node's least neighbouring label, hooks old labels onto it and follows labels twice, so a
    chain of n nodes takes about log n rounds.  Nothing but the count of changes comes to the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        hooks = step.where("least < label").groupBy(F.col("label").alias("node")).agg(F.min("least").alias("hook"))
        new = step.join(hooks, "node", "left").select("node", "label", F.least("least", F.coalesce("hook", "least")).alias("new"))
        new = written(new, "step")
        up = new.select(F.col("node").alias("new"), F.col("new").alias("up"))
        labels = new.join(up, "new").select("node", "label", F.col("up"))
        labels = written(labels, "labels")
        if labels.where("up <> label").limit(1).count() == 0:
            return labels.select("node", "label")
        labels = labels.select("node", F.col("up").alias("label"))
