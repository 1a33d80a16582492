"""Connected components of a graph of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadine.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every end of a link; ``links`` has long columns a and b.

    In each round every node takes the least label among its own and its neighbours', and then the label of that label. Labels
    only fall, so the rounds end; each round's labels are a written table.
    """
    edges = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.table(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy(F.col("a").alias("id2")).agg(F.min("component").alias("least"))
        lower = labels.join(near, labels.id == near.id2).select("id", F.col("component").alias("was"), F.least("component", "least").alias("step"))
        ahead = labels.select(F.col("id").alias("id3"), F.col("component").alias("jump"))
        new = scratch.table(lower.join(ahead, lower.step == ahead.id3).select("id", F.least("step", "jump").alias("component"), (F.least("step", "jump") < F.col("was")).alias("changed")), "labels")
        scratch.drop(labels)
        labels = new
        if labels.where("changed").isEmpty():
            scratch.drop(edges)
            out = labels.select("id", "component")
            out._scratch = labels._scratch
            return out
