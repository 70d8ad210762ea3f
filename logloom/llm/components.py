"""Connected components of a link table, by shared labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import swept

from .common import checkpointed

ROWS = 100_000  # of the link table, that a task of a round takes

def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of links (a, b).

    Each round takes the smallest label among neighbours, then the label of that label. Near-duplicates make
    short chains, which takes few rounds; a long chain whose ids lie in an adverse order may take as many
    rounds as it has nodes. A node's neighbours count by an aggregate, so a hub is no group of one task.
    Labels are cut off in the shared checkpoint folder. A round has as many tasks as its links need, however many
    partitions the session has, and what rounds have shuffled goes at the end."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    tasks = max(1, both.count() // ROWS)
    both = both.coalesce(tasks)
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = checkpointed(labels.coalesce(tasks))
    while True:
        near = both.join(labels, both.b == labels.node).select("a", "label").coalesce(tasks).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")).coalesce(tasks)
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = least.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label"))
        now = checkpointed(now.coalesce(tasks))
        labels = now.select("node", "label")
        if now.where("was <> label").isEmpty():
            swept(links.sparkSession)
            return labels.withColumnRenamed("label", "component")
