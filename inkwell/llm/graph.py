"""Connected components of a table of links, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``; label: the least node of its component.

    Each round takes the least label among a node's neighbours and then that label's own
    label, so long chains halve. Minima are partial aggregates: a node with very many links
    is no hot task. Rounds are written to the shared folder, and end when nothing changes.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct()
    scratch = Scratch(links.sparkSession)
    both = scratch.write("links", both)
    labels = scratch.write("labels", both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.write("new", step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = new.select("node", "label")
        scratch.drop("labels")
        scratch.paths["labels"] = scratch.paths.pop("new")
        if new.filter("label != old").isEmpty():
            scratch.drop("links")
            return labels
