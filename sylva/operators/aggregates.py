"""Counts, rankings and set operations over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from . import ordering


def ext_cardinality(entries: DataFrame) -> DataFrame:
    return entries.filter("ext is not null").groupBy("ext").agg(F.count("*").alias("n"))


def cardinality_histogram(entries: DataFrame) -> DataFrame:
    """How many extensions have how many files, in powers of ten."""
    n = ext_cardinality(entries)
    return n.groupBy(F.floor(F.log10("n")).cast("int").alias("bucket")).agg(F.count("*").alias("extensions"), F.sum("n").alias("files"))


def distinct_names(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def type_split(entries: DataFrame) -> DataFrame:
    return entries.groupBy("is_dir").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def scan_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n"), F.count_if("is_dir").alias("dirs"), F.max("depth").alias("max_depth"), F.sum("size").alias("bytes"))


def name_ranks(entries: DataFrame) -> DataFrame:
    """fname, rank: the dense rank, from 0, of each distinct folded name."""
    names = entries.select(fold(F.col("dname")).alias("fname")).distinct()
    return ordering.positions(names, [F.col("fname")], name="rank", first=0)


def ranks_below(entries: DataFrame, names: list[str]) -> DataFrame:
    """name, below: how many distinct folded names sort before each of a few given names."""
    distinct = entries.select(fold(F.col("dname")).alias("fname")).distinct()
    row = distinct.agg(*[F.count_if(F.col("fname") < F.lit(n)).alias(f"c{i}") for i, n in enumerate(names)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("below")) for i, n in enumerate(names)])).alias("r")).select("r.*")
