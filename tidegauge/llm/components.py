"""Connected components of a links table, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps


def components(links: DataFrame) -> DataFrame:
    """id, comp of every id in links(x, y): comp is the smallest id that it reaches. Links
    without an id at an end, and from an id to itself, say nothing. Each round takes the
    least label of the neighbours, then the label of that label, which halves what is left
    of a chain; rounds end when nothing changes. Every step is a join or a grouped minimum,
    which Spark combines before its shuffle, so a hub is no single task's work; each is
    stored, and the ones before it are dropped."""
    steps = Steps(links.sparkSession, "components")
    pairs = links.select("x", "y").where("x != y")
    both = steps.store("edges", pairs.union(pairs.select("y", "x")).distinct())
    labels, n = both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("comp")), 0
    labels = steps.store("labels-0", labels)
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        spread = labels.join(near.withColumnRenamed("x", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        jump = spread.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("further")), "to")
        after = steps.store(f"labels-{n + 1}", jump.select("id", "old", F.least("to", "further").alias("comp")))
        steps.drop(f"labels-{n}")
        labels, n = after.select("id", "comp"), n + 1
        if after.where("old != comp").isEmpty():
            steps.drop("edges")
            return labels
