"""Connected components of a graph given by its edges, for graphs too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): for each node on an edge, the least node it can reach.

    Large-star and small-star rounds until the edges stand still: each round is two aggregations and two joins
    of the edges, whose number doesn't grow, and there are about log(nodes) rounds. Each round cuts its lineage.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        now = cut(small.distinct())
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen:
            break
        mark = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
