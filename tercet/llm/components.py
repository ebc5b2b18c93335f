"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is an aggregation and a join; neighbour lists are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches.  Loops and repeated edges do not matter.

    An error is raised if `most` rounds are not enough (they are for components of up to 2**30 nodes in a line).
    """
    e = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    for _ in range(most):
        now = _state(e)
        if now == before or not now[0]:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(e.select("v", "v").distinct())
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", "m")).distinct()
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    raise RuntimeError("components did not settle")
