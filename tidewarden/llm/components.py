"""Connected components of an undirected graph given as pairs, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node of its component) of all nodes in the pairs a, b.

    Every round a node takes the smallest label among its neighbours and then the label of that
    label, so a path of n nodes needs about log n rounds. Rounds are written, not kept in lineage.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    edges = written(both.distinct(), "edges")
    labels = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = written(labels, "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("low")
        )
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = step.join(far, "low").select("node", "old", F.least("low", "far").alias("label"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "comp")
