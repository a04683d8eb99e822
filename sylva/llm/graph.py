"""Connected components of a link table by alternating large and small stars, a checkpointed table per round.

The smallest neighbour of each node is written before it is joined to the edges: both sides of the join are then
plain exchanges, which adaptive execution splits where a node has very many edges.

Rows with a null end and edges from a node to itself name no link. Repeated edges count once. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(e: DataFrame) -> DataFrame:
    """w, m: the smallest neighbour of each node u of e."""
    return common.written(e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u").toDF("u", "v"))
    least = _least(both).select("w", F.least("w", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component for each node of edges (u, v); a component is named by its smallest node."""
    e = common.written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = _sum(e)
    while seen[0]:
        e = common.written(_small(common.written(_large(e), "stars")), "links")
        now = _sum(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
