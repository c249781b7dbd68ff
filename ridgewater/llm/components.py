"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgewater.session import stage


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable over the edges (a, b), for every node.

    Each round hooks all neighbours of a node, above it in the large step and below it in the small step, to the
    smallest of them, until nothing changes; the number of rounds grows with the logarithm of the longest path. Every
    round is written out and lists are only ever reduced to their minimum, so no group is gathered.
    """
    edges = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(small_least, "a")
        small = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hooked.select("a", F.col("m").alias("b")))
        small = stage(small.filter("a != b").distinct(), "edges")
        same = edges.join(small, ["a", "b"], "left_anti").isEmpty() and small.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    labels = edges.groupBy("a").agg(F.min("b").alias("label"))
    return stage(
        nodes.select("id").join(labels.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label")),
        "labels",
    )
