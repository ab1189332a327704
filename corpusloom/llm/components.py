"""Connected components of a large graph: alternating large and small stars, every step an aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Parts that the neighbours of one vertex are dealt into where they are joined with its least neighbour.
SALTS = 8


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c): every vertex of an edge and the least vertex that it is connected with.

    Neighbours are never gathered: a vertex's least neighbour is an aggregate, joined back to its edges by vertex and
    salt, so the edges of a vertex with very many are dealt over tasks, which adaptive execution can split further.
    Steps go as the logarithm of the size of the largest component. Each step is cut with a checkpoint."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e, mark = _counted(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        dealt = both.where("v > u").withColumn("s", F.pmod(F.hash("v"), F.lit(SALTS)))
        spread = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = dealt.join(spread, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e, now = _counted(small.distinct())
        if now == mark:
            break
        mark = now
    stars = e.select(F.col("u").alias("v"), F.col("v").alias("c"))
    return stars.union(stars.select(F.col("c").alias("v"), "c").distinct())


def _counted(e: DataFrame) -> tuple[DataFrame, tuple]:
    e = cut(e)
    return e, tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20,0)))")).first())
