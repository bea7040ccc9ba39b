"""Connected components of a table of links, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node of each node's component, for every node in links (two columns of longs).

    Each round gives a node the smallest label among its own and its neighbours', then the label of that label, so labels
    travel further each round; the search ends when a round changes none. Labels are written each round, so lineage stays
    short; only whether there was a change reaches the driver. Links with a null are none.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a != b")
    both = common.materialise(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = common.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    past = labels
    while True:
        # the smallest label next to each node
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        # the label of that label
        above = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = step.join(above, F.col("low") == F.col("n2"), "left").select("node", "old", F.least("low", F.coalesce("l2", "low")).alias("label"))
        step = common.materialise(step, "labels")
        common.discard(past)
        labels, past = step.select("node", "label"), step
        if step.filter("old != label").limit(1).count() == 0:
            common.discard(both)
            return labels.select("node", F.col("label").alias("component"))
