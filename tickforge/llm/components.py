"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.sources.stored import stored


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``; the component is the smallest id reachable.

    Every round takes the smallest label among the neighbours and then follows the label's own label,
    so the number of rounds grows with the logarithm of the longest path. Each round is a written
    table: a lost executor costs at most one round. Labels travel through shuffles only.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("offer"))
        taken = labels.join(offered, labels["id"] == offered["a"], "left").select(
            "id", F.col("component").alias("before"), F.least("component", F.coalesce("offer", "component")).alias("component"))
        of = labels.select(F.col("id").alias("_id"), F.col("component").alias("_next"))
        jumped = taken.join(of, taken["component"] == of["_id"], "left").select(
            "id", "before", F.least("component", F.coalesce("_next", "component")).alias("component"))
        step = stored(jumped, "labels")
        labels = step.select("id", "component")
        if step.where(F.col("component") != F.col("before")).isEmpty():
            return labels
