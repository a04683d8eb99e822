"""What a result shows: the optional columns, and rows as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILETIME_EPOCH, TICKS = 11_644_473_600, 10_000_000
#: The size that stands for a directory's.
DIRECTORY_SIZE = "18446744073709551615"
COLUMNS = ("path", "attributes", "size", "date_modified", "date_created", "file_list_filename", "date_recently_changed")


def filetime(seconds: Column) -> Column:
    """100-nanosecond ticks since 1601 of epoch seconds."""
    return (seconds + F.lit(FILETIME_EPOCH)) * F.lit(TICKS)


def column(name: str) -> Column:
    return {
        "path": F.col("parent_path"), "attributes": F.col("attributes"), "size": F.when(F.col("is_dir"), F.lit(DIRECTORY_SIZE)).otherwise(F.col("size").cast("string")),
        "date_modified": filetime(F.col("mtime")), "date_created": filetime(F.col("ctime")), "date_recently_changed": filetime(F.col("mtime")), "file_list_filename": F.col("path"),
    }[name].alias(name)


def project(df: DataFrame, columns: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """The chosen columns in their fixed order, then kind and name; keep: further columns in front."""
    chosen = [column(c) for c in COLUMNS if c in columns]
    kind = F.when(F.col("is_dir"), F.lit("FOLDER")).otherwise(F.lit("FILE")).alias("kind")
    return df.select(*keep, *chosen, kind, F.col("dname").alias("name"))


def result_lines(df: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """One string per row: the chosen columns by name, then FOLDER or FILE with the name."""
    parts = [F.concat(F.lit(f" {c.upper()} "), column(c).cast("string"), F.lit("\n")) for c in COLUMNS if c in columns]
    kind = F.when(F.col("is_dir"), F.lit(" FOLDER ")).otherwise(F.lit(" FILE "))
    return df.select(F.concat(*parts, kind, F.col("dname")).alias("line"))


def listing_lines(df: DataFrame) -> DataFrame:
    """One string per row: type letter, size, date and minute (UTC), path."""
    when = F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm")
    return df.select(F.format_string("%s %12d  %s  %s", F.when(F.col("is_dir"), F.lit("d")).otherwise(F.lit("-")), F.col("size"), when, F.col("path")).alias("line"))


def list_directory(entries: DataFrame, path: str) -> DataFrame:
    """The direct children of a directory by name."""
    from .leaves import normal_path

    return entries.filter((F.col("parent_path") == normal_path(path)) & F.col("parent").isNotNull())
