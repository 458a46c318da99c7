"""Connected components of a graph given as edges, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay.session import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its least node) for every node that an edge names.

    Every round takes the least label among neighbours (combined before the shuffle, so a hub is one row) and then the
    label's own label; the rounds grow with the logarithm of the longest path. Labels are written each round, and only the
    number of changes comes to the driver.
    """
    both = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = written = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("component")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["node"] == near["u"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        step = materialize(least.join(up, F.col("mid") == F.col("up"), "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("component")), "labels")
        changed = step.filter(F.col("old") != F.col("component")).limit(1).count()
        discard(written)
        written, labels = step, step.select("node", "component")
        if not changed:
            discard(both)
            return labels
