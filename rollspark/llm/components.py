"""Connected components of an edge table, by repeated smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollspark.llm.common import write_once


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the smallest node it is connected to.

    A round gives every node the smallest label among its neighbours' labels and
    then that label's own label, so path lengths fall by half or more. Labels
    are written between rounds; nothing but the count of changes reaches the
    driver. Sums and joins by node are pre-aggregated or split by Spark, so a
    node with very many edges is no obstacle.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = write_once(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_once(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m")))
        step = (labels.join(near, labels["node"] == near["a"], "left")
                .select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("mid")))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        written = write_once(moved, "labels")
        labels = written.select("node", "label")
        if written.where("label <> old").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
