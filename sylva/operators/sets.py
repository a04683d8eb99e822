"""Set operations over the ids of matched entries, and the union of the roots' top levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*matched: DataFrame) -> DataFrame:
    """id: entries in any of the results."""
    out = matched[0].select("id")
    for m in matched[1:]:
        out = out.union(m.select("id"))
    return out.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """id: entries in both results."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """id: entries in the first result alone."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def top_levels(entries: DataFrame) -> DataFrame:
    """What stands right below any root: the listing of a catalog of several trees."""
    roots = entries.filter("parent is null").select(F.col("id").alias("_root"))
    return entries.join(F.broadcast(roots), entries["parent"] == F.col("_root"), "left_semi")
