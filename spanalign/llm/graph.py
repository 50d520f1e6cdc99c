"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanalign.session import written


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node in ``links`` (``a, b``).

    Every round takes the smallest label among neighbours and then follows the label's own label, so long
    chains shorten quickly.  Rounds are written to the shared folder; nothing but a flag reaches the driver.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        labels = written(labels, "labels")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("lower"))
        own = lower.select(F.col("node").alias("lower"), F.col("lower").alias("next"))
        stepped = written(lower.join(own, "lower", "left").select(
            "node", "component", F.least("lower", F.coalesce("next", "lower")).alias("found")), "labels")
        labels = stepped.select("node", F.col("found").alias("component"))
        if stepped.where("found <> component").isEmpty():
            return labels
