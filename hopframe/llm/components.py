"""Connected components of a link table, without any group or table on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b). Nodes without links don't appear.

    Each round every node takes the smallest label among its neighbours and then its label's label; rounds
    end when no label changes. Every round is a stored table, so a lost executor costs one round at most.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    edges = common.stage(both.where("u <> v").distinct(), "edges")
    labels = common.stage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("next"))
        ahead = new.select(F.col("u").alias("next"), F.col("next").alias("jump"))
        new = common.stage(new.join(ahead, "next").select("u", "label", F.least("next", "jump").alias("next")), "labels")
        changed = new.where("next <> label").limit(1).count()
        labels = new.select("u", F.col("next").alias("label"))
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
