"""Connected components by iterated joins: least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """node, label: the least node that each node of the edges (a, b) reaches.

    A round gives each node the least label among its neighbours and then the
    label of that label, so distances halve; labels are summed up in partial
    minima, so a node with many edges does not gather them in one task.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    before = labels
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jumped"))
        new = stored(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("jumped", "low")).alias("label"), (F.least("low", F.coalesce("jumped", "low")) < F.col("label")).alias("moved")))
        discard(before)
        before, labels = new, new.select("node", "label")
        if new.where("moved").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"labels still change after {most} rounds")
