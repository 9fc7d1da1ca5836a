"""Connected components of a link table, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import held


def component_labels(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (a, b); label is the smallest id of the component.

    Each round takes the smallest label among the neighbours and then the label of that label, so the number of rounds
    follows the logarithm of a component's breadth. Labels are written after each round, which cuts the lineage.
    """
    edges = held(
        links.select(F.col("a").alias("id"), F.col("b").alias("other"))
        .union(links.select(F.col("b"), F.col("a"))), "edges")
    labels = held(edges.groupBy("id").agg(F.min("other").alias("low")).select(
        "id", F.least("id", "low").alias("label")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("low"))
        near = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        fresh = held(near.join(jump, "near").select("id", "old", F.least("near", "far").alias("label")), "labels")
        labels = fresh.select("id", "label")
        if fresh.where("label <> old").isEmpty():
            return labels
