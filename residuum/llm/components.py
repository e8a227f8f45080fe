"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.shared import Workspace


def connected_components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``): the smallest
    node that links reach.  Each round takes the smallest label of a node's
    neighbours and then the label of that label, so the rounds grow with the
    logarithm of the longest chain; each is written to the shared folder.
    """
    both = work.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = work.table(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("_near")))
        met = labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "_near").alias("_low"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_far"))
        new = met.join(jump, met._low == jump._n, "left").select(
            "node", F.least("_low", F.coalesce("_far", "_low")).alias("component"), (F.least("_low", F.coalesce("_far", "_low")) < F.col("component")).alias("_moved"))
        new = work.table(new, f"{name}-{step}")
        moved = new.filter("_moved").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
