"""Connected components of a links table, by the least label that a node can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of all nodes in links(a, b), in any order and with repeats.

    Each round takes the least label of a node's neighbours, then the label of that label, so that
    a chain of n nodes takes about log n rounds; each round is a written table, the last of which stays. No links: no rows.
    """
    scratch = Scratch(links.sparkSession, "components")
    both = scratch.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.col("a") != F.col("b")).distinct(), "links")
    labels = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("label").alias("further"))
        after = scratch.written(least.join(jump, "m", "left").select("node", F.least("m", F.coalesce("further", "m")).alias("new"), "label"), "labels")
        changed = after.filter(F.col("new") != F.col("label")).limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            labels = written(labels, "component-labels")
            scratch.clear()
            return labels
