"""Connected components over an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, source: str = "u", target: str = "v") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Loops, repeated edges and edges with a null end change nothing. Every round is a few shuffles of the edges,
    written to the shared folder, and the rounds grow as the logarithm of a component's size. Nothing but two
    numbers of each round reaches the driver; a round's tables go when the next one's are written.
    """
    u, v = F.col(source).cast("long"), F.col(target).cast("long")
    stars = materialize(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where((u != v)).distinct(), "edges")
    mark = _mark(stars)
    while mark[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large")
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        later = materialize(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(stars, near, large, lowest)
        stars, before = later, mark
        mark = _mark(stars)
        if mark == before:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
