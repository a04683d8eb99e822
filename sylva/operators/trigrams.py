"""An index of the runs of three characters in folded names: which entries hold each, and substring search over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, folded


def runs(name: Column) -> Column:
    """The distinct runs of three characters of a folded name of three or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substr(name, i, F.lit(3))))


def postings(entries: DataFrame) -> DataFrame:
    """trigram, id: a row for each entry and run of its name."""
    held = entries.filter(F.length("dname") >= 3).select("id", F.explode(runs(fold(F.col("dname")))).alias("trigram"))
    return held.select("trigram", "id")


def cardinality(entries: DataFrame) -> DataFrame:
    """trigram, n: the number of entries whose folded name holds each run of three characters."""
    return postings(entries).groupBy("trigram").agg(F.count("*").alias("n"))


def store(entries: DataFrame, path: str) -> None:
    """Writes the postings in order of the trigrams, so that a search reads the row groups of its own alone."""
    postings(entries).repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "id").write.mode("overwrite").parquet(path)


def containing(entries: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """The entries whose name holds a text, case apart: those that hold all its runs, tested on the name itself.

    A text of under three characters has no run: all names are tested.
    """
    needle = folded(text)
    found = F.contains(fold(F.col("dname")), F.lit(needle))
    wanted = sorted({needle[k : k + 3] for k in range(len(needle) - 2)})
    if not wanted:
        return entries.filter(found)
    may = index.filter(F.col("trigram").isin(wanted)).groupBy("id").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(wanted)).select(F.col("id").alias("_may"))
    return entries.join(may, entries["id"] == may["_may"], "left_semi").filter(found)
