"""Connected components by hooking to smaller labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Each round gives a node the smallest label of its neighbours and then the label of its
    label, so that the number of rounds is about the logarithm of the longest path. Minima
    combine before the shuffle, so a hub's edges need not meet in one task. Only the last labels stay, in ``scratch``.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    both = scratch.cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = table = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        moved = scratch.cut(hooked.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("component"), (F.col("component") > F.least("low", F.coalesce("far", "low"))).alias("moved")), "labels")
        scratch.free(table)
        labels, table = moved.select("node", "component"), moved
        if not moved.where("moved").limit(1).count():
            scratch.free(both)
            return labels
