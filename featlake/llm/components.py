"""Connected components of a table of links by contraction, with every round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.session import write_and_read


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for each node of ``links`` (a, b).

    In a round every node takes the smallest id next to it, and links are drawn anew
    between the ids taken; a link within one id is done. Repeated links, loops and
    an empty table are fine. Rounds grow with the logarithm of a component's length.
    """
    edges = write_and_read(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = write_and_read(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = write_and_read(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("to")), "nearest")
        to = lambda name: nearest.select(F.col("id").alias(name), F.col("to").alias(f"{name}_to"))
        labels = write_and_read(
            labels.join(to("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")),
            "labels",
        )
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        edges = write_and_read(
            moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges"
        )
    return labels
