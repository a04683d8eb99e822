"""Change events: from paths to dirty directories, as batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import storage
from ..sources.catalog import parent_path

#: Kinds that name a path whose directory is to be listed anew, and kinds that say that events were lost.
CHANGES = ("create", "delete", "moved", "moved_from", "moved_to")
LOSSES = ("overflow", "unresolved")
#: Marks after which a burst is applied without waiting for its end.
BURST_MARKS = 256
#: Rows of a range that one task orders, about.
RANGE_ROWS = 100_000
SCHEMA = "ts timestamp, kind string, path string, old_path string"


def touched_paths(events: DataFrame) -> DataFrame:
    """ts, dir: the parent directory of each path that a change names (both of a move)."""
    paths = F.array_compact(F.array("path", "old_path"))
    x = events.filter(F.col("kind").isin(*CHANGES)).select("ts", F.explode(paths).alias("p"))
    return x.select("ts", parent_path(F.col("p")).alias("dir"))


def under_roots(paths: DataFrame, roots: list[str]) -> DataFrame:
    """Rows whose dir is a root or lies in one, component by component."""
    test = F.lit(False)
    for r in roots:
        r = r.rstrip("/") or "/"
        test = test | (F.col("dir") == r) | F.startswith("dir", F.lit(r.rstrip("/") + "/"))
    return paths.filter(test)


def dirty_directories(events: DataFrame, directories: DataFrame, roots: list[str]) -> DataFrame:
    """dir_id: the known directories (id, path) to list anew, each once."""
    named = under_roots(touched_paths(events), roots).select("dir").distinct()
    return named.join(directories.select(F.col("id").alias("dir_id"), F.col("path").alias("dir")), "dir").select("dir_id")


def lost(events: DataFrame) -> DataFrame:
    """losses: how many events say that others were lost; any calls for a full pass and a sweep."""
    return events.agg(F.count_if(F.col("kind").isin(*LOSSES)).alias("losses"))


def coalesced(events: DataFrame, gap: str = "50 milliseconds", most: int = BURST_MARKS) -> DataFrame:
    """begin, marks, dirs: bursts of changes that no pause of `gap` divides, cut after `most` marks, so that a long burst
    is applied as it goes on. events: one batch.

    Marks of one time and directory are one row with their number. Rows are dealt by time and directory in ranges that are
    ordered each by itself; where a burst began that runs on into a range comes from a row per range. No task sees all
    marks. The rows are pinned: storage.release() lets them go.
    """
    held = storage.pinned(touched_paths(events).groupBy("ts", "dir").agg(F.count("*").alias("n")))
    ranges = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // RANGE_ROWS))
    x = held.repartitionByRange(ranges, "ts", "dir").sortWithinPartitions("ts", "dir").withColumn("at", F.monotonically_increasing_id())
    x = x.withColumn("range", F.shiftright("at", 33)).repartition(ranges, "range")
    order = Window.partitionBy("range").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    near = lambda before, ts: F.coalesce(before + F.expr(f"interval {gap}") > ts, F.lit(False))
    x = x.withColumn("pos", F.sum("n").over(so_far) - F.col("n")).withColumn("before", F.lag("ts").over(order))
    fresh = (F.col("at").bitwiseAND((1 << 33) - 1) > 0) & ~near(F.col("before"), F.col("ts"))
    x = storage.pinned(x.withColumn("start", F.max(F.when(fresh, F.col("pos"))).over(so_far)).drop("before"))

    # a row per range: the marks before it, and where the burst of its first row began
    s = x.groupBy("range").agg(F.min_by("ts", "at").alias("first"), F.max_by("ts", "at").alias("last"), F.sum("n").alias("size"), F.max("start").alias("tail"))
    along = Window.orderBy("range")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumn("runs_on", near(F.lag("last").over(along), F.col("first")))
    s = s.withColumn("own", F.coalesce(F.col("base") + F.col("tail"), F.when(~F.col("runs_on"), F.col("base"))))
    head = F.when(F.col("runs_on"), F.last("own", ignorenulls=True).over(earlier)).otherwise(F.col("base"))
    x = x.join(F.broadcast(s.select("range", "base", head.alias("head"))), "range")

    # marks without a time, and all where the gap is none, are bursts of their own
    step = F.when(near(F.col("ts"), F.col("ts")), F.lit(most)).otherwise(F.lit(1))
    start = F.coalesce(F.col("base") + F.col("start"), F.col("head"))
    x = x.select("ts", "dir", "n", start.alias("burst"), (F.col("base") + F.col("pos") - start).alias("off"), step.alias("step"))
    x = x.withColumn("lo", F.floor(F.col("off") / F.col("step"))).withColumn("hi", F.floor((F.col("off") + F.col("n") - 1) / F.col("step")))
    # the parts that a row's marks fall in, a thousand at a time
    x = x.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / 1000), F.floor(F.col("hi") / 1000))))
    x = x.withColumn("part", F.explode(F.sequence(F.greatest("lo", F.col("k") * 1000), F.least("hi", F.col("k") * 1000 + 999))))
    within = F.least(F.col("off") + F.col("n"), (F.col("part") + 1) * F.col("step")) - F.greatest("off", F.col("part") * F.col("step"))
    return x.groupBy("burst", "part").agg(F.min("ts").alias("begin"), F.sum(within).alias("marks"), F.count_distinct("dir").alias("dirs")).drop("burst", "part")


def follow(events: DataFrame, directories: Callable[[], DataFrame], roots: list[str], apply: Callable[[DataFrame, int], None], full: Callable[[int], None]) -> DataStreamWriter:
    """A stream of events that calls apply with each batch's dirty directories, or full after a loss.

    A batch that is replayed names the same directories again; listing them anew is harmless.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if lost(batch).first()[0]:
            full(number)
        else:
            apply(dirty_directories(batch, directories(), roots), number)
        batch.unpersist()

    return events.writeStream.foreachBatch(each)
