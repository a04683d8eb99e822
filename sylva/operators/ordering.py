"""Total orders, global positions and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import fold


def sort_columns(key: str) -> list[Column]:
    """The columns of a key's order; the id comes last, so that every order is total."""
    name, path, ident = fold(F.col("dname")), fold(F.col("path")), F.col("id")
    return {
        "name": [name, ident], "path": [path, name, ident], "file_list_filename": [path, name, ident], "size": [F.col("size"), ident], "inverse_size": [F.col("size"), ident],
        "extension": [F.coalesce("ext", F.lit("")), name, ident], "attributes": [F.col("attributes"), ident],
        "date_modified": [F.col("mtime"), ident], "date_created": [F.col("ctime"), ident], "date_recently_changed": [F.col("mtime"), ident],
    }[key]


SORT_KEYS = ("name", "path", "size", "inverse_size", "extension", "date_created", "date_modified", "attributes", "file_list_filename", "date_recently_changed")
SORT_NAMES = {f"{k}_{d}": (k, d == "ascending") for k in SORT_KEYS for d in ("ascending", "descending")}


def sort_key(name: str) -> tuple[list[Column], bool]:
    """The columns that a sort name stands for, and whether they ascend."""
    if name.lower() not in SORT_NAMES:
        raise ValueError(f"no such sort: {name}")
    key, ascending = SORT_NAMES[name.lower()]
    return sort_columns(key), ascending


def directed(columns: list[Column], ascending: bool) -> list[Column]:
    """A descending order is the ascending one reversed, ids included."""
    return [c.asc() if ascending else c.desc() for c in columns]


def page(df: DataFrame, columns: list[Column], ascending: bool = True, offset: int = 0, count: int | None = None) -> DataFrame:
    """A slice of the ordered rows; None: all that follow. With a count, Spark keeps only the top rows per task."""
    out = df.orderBy(*directed(columns, ascending))
    if offset:
        out = out.offset(offset)
    return out if count is None else out.limit(count)


def positions(df: DataFrame, columns: list[Column], ascending: bool = True, name: str = "pos", first: int = 1) -> DataFrame:
    """df with each row's place in a total order.

    Rows are range-partitioned by the order and numbered within their partition; the partitions' sizes, a row
    each, give the offsets. No task sees all rows. The bounds of a range partitioning are drawn anew each time it is
    computed, so the dealt rows are pinned: storage.release() lets them go.
    """
    keys = [f"_k{i}" for i in range(len(columns))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(columns, keys, strict=True)])
    order = directed([F.col(k) for k in keys], ascending)
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    dealt = storage.pinned(dealt)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))  # a row per partition
    out = dealt.join(F.broadcast(offsets), dealt["_part"] == offsets["_p"])
    return out.withColumn(name, F.col("_before") + F.col("_row") + first).drop("_at", "_part", "_row", "_p", "_before", *keys)
