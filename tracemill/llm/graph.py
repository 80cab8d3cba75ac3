"""Connected components by label propagation with pointer jumping, stored between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.storage import Workspace


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, label) of every node that a link (a, b) names; label is the smallest node reachable.

    A round takes the smallest label among a node and its neighbours and then the label of that label, so paths halve;
    each round's labels are a stored table, and the loop ends when a round changes none.  Links and labels stay on the
    executors; repeated links, loops and both directions are fine, and no links give no rows.
    """
    both = space.save(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), f"{name}-links"
    )
    labels = space.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "at")
        )
        lower = labels.join(near, labels["node"] == near["at"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = space.save(lower.join(jump, lower["step"] == jump["via"], "left").select("node", F.least("step", "far").alias("label"), "old"), f"{name}-{k}")
        changed = new.where("label <> old").limit(1).count()
        space.remove(f"{name}-{k - 1}")
        labels = new.select("node", "label")
        if not changed:
            space.remove(f"{name}-links")
            return labels
