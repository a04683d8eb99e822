"""build and update: a catalog from file trees, and the passes that bring it forward."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..sources import catalog, files
from . import incremental, ordering

log = logging.getLogger(__name__)


def roots_of(spark: SparkSession, roots: list[str] | tuple[str, ...] = (), roots_file: str | None = None) -> list[str]:
    """The absolute paths of roots given and of those in a file; refused if there are none, too many, or if they overlap."""
    found = [os.path.abspath(r) for r in roots]
    if roots_file:
        found += [r.name for r in files.roots_file(spark, roots_file).limit(files.MAX_ROOTS + 1).collect()]
    if not found:
        raise ValueError("no roots")
    if len(found) > files.MAX_ROOTS:
        raise ValueError(f"more than {files.MAX_ROOTS} roots")
    over = catalog.overlapping_roots(spark.createDataFrame([(r,) for r in found], "path string")).distinct().collect()
    if over:
        raise ValueError("; ".join(f"{r.path} lies in {r.outer}" for r in over))
    return found


def build(spark: SparkSession, roots: list[str] | tuple[str, ...] = (), roots_file: str | None = None, out: str | None = None) -> DataFrame:
    """The base entries of the trees under the roots, saved as a new version of the snapshot at out if one is given."""
    base = files.scan(spark, roots_of(spark, roots, roots_file))
    if out is None:
        return base
    catalog.save(base, out)
    return catalog.load(spark, out)


def reload(spark: SparkSession, out: str, roots: list[str] | tuple[str, ...] = (), roots_file: str | None = None) -> bool:
    """Builds the snapshot at out anew if the wanted roots are not those it covers; whether it did. Readers keep the old
    version until the new one has its name."""
    wanted = spark.createDataFrame([(r,) for r in roots_of(spark, roots, roots_file)], "name string")
    if not incremental.roots_changed(catalog.roots(catalog.load(spark, out)), wanted).limit(1).count():
        return False
    build(spark, roots, roots_file, out)
    return True


@dataclass
class Updated:
    """base: the catalog after the pass. counts: entries added, removed (each with what is below it) and touched, directories
    listed and failed.
    changed: whether a query could answer differently, that is, whether the epoch moves."""

    base: DataFrame
    counts: dict[str, int]
    changed: bool


def _named(dirs: DataFrame, paths: list[str], only_roots: bool) -> DataFrame:
    wanted = {os.path.normpath(p) for p in paths}
    known = dirs.filter(F.col("path").isin(sorted(wanted)) & (F.col("parent").isNull() if only_roots else F.lit(True)))
    missing = wanted - {r.path for r in known.select("path").collect()}
    if missing:
        what = "a root" if only_roots else "a directory"
        raise ValueError(f"not {what} of this catalog: {', '.join(sorted(missing))}")
    return known


def update(base: DataFrame, roots: list[str] | tuple[str, ...] = (), dirs: list[str] | tuple[str, ...] = (), deep: bool = False, sweep: bool = False) -> Updated:
    """Brings a catalog forward from the file trees that it covers.

    All roots are listed, or those given, or the directories given (dirs, not together with roots). A directory's
    subdirectories are listed in turn if they are new or their stamp moved; with deep all are, and attributes of files
    are compared too. sweep lists every directory whose stamp moved, also below ones that did not. Names that are
    not of this catalog are refused, and a directory that cannot be read keeps what is known of it.

    Each round lists one level, distributed over the executors; changes are applied once, at the end.
    """
    if roots and dirs:
        raise ValueError("give either roots or directories, not both")
    spark = base.sparkSession
    known = catalog.with_paths(catalog.live(base)).filter("is_dir").select("id", "parent", "path", "depth")
    known = storage.pinned(known)
    if dirs:
        dirty = _named(known, list(dirs), False)
    else:
        dirty = _named(known, list(roots), True) if roots else known.filter("parent is null")
        if not dirty.limit(1).count():
            raise ValueError("the catalog has no root")
    dirty = dirty.select(F.col("id").alias("dir_id"), "path", "depth")
    if sweep and not dirs:
        moved = incremental.sweep(base, files.stamps(known))
        dirty = dirty.unionByName(known.join(moved, known["id"] == moved["dir_id"]).select("dir_id", "path", "depth")).distinct()
    last = base.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    done, changes, counts = None, None, {"listed": 0, "failed": 0}
    for _ in range(catalog.MAX_LEVELS):
        dirty = storage.pinned(dirty)
        n = dirty.count()
        if not n:
            break
        counts["listed"] += n
        seen = storage.pinned(files.listing(dirty.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))))
        closed = seen.filter("name is null and is_dir is null").select("dir_id")
        counts["failed"] += closed.count()
        read = dirty.join(closed, "dir_id", "left_anti")
        found = incremental.reconcile(base, seen.filter("name is not null"), read.select("dir_id"), deep)
        fresh = ordering.positions(found.filter("action = 'add'"), [F.col("parent"), F.col("name")], name="_n")
        fresh = fresh.withColumn("id", F.lit(last) + F.col("_n")).drop("_n")
        found = storage.pinned(found.filter("action <> 'add'").unionByName(fresh).unionByName(_own(base, seen, read)))
        last += found.filter("action = 'add'").count()
        changes = found if changes is None else changes.unionByName(found)
        done = dirty.select("dir_id") if done is None else done.unionByName(dirty.select("dir_id"))
        dirty = _below(base, found, seen, read, deep).join(done, "dir_id", "left_anti")
    if changes is None:
        return Updated(base, counts | {"added": 0, "removed": 0, "touched": 0}, False)
    # a directory can be touched by its parent's listing and by its own: the last word is that of its own
    touched = changes.filter("action = 'touch'").groupBy("id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "id"]),
        F.col("name").isNull().cast("int")).alias("t")).select("id", "t.*")
    changes = storage.pinned(changes.filter("action <> 'touch'").unionByName(touched.select(*changes.columns)))
    counts |= {"added": 0, "removed": 0, "touched": 0} | {{"add": "added", "remove": "removed",
        "touch": "touched"}[r.action]: r["count"] for r in changes.groupBy("action").count().collect()}
    log.info("updated: %s", counts)
    return Updated(incremental.apply_changes(base, changes), counts, any(counts[k] for k in ("added", "removed", "touched")))


def _own(base: DataFrame, seen: DataFrame, read: DataFrame) -> DataFrame:
    """Touches for the listed directories whose own row is not as it was kept; new ones have no row yet."""
    own = seen.filter("name is null and is_dir").join(read.select("dir_id"), "dir_id", "left_semi")
    kept = base.filter("not deleted").select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), *[F.col(c).alias(f"k_{c}") for c in (*incremental.ATTRIBUTES, "stamp")])
    other = F.lit(False)
    for c in (*incremental.ATTRIBUTES, "stamp"):
        other = other | ~F.col(c).eqNullSafe(F.col(f"k_{c}"))
    x = own.join(kept, own["dir_id"] == kept["_id"]).filter(other)
    return x.select(F.lit("touch").alias("action"), F.col("dir_id").alias("id"), F.col("_parent").alias("parent"),
        F.lit(None).cast("string").alias("name"), "is_dir", *incremental.ATTRIBUTES, "stamp")


def _below(base: DataFrame, found: DataFrame, seen: DataFrame, read: DataFrame, deep: bool) -> DataFrame:
    """dir_id, path, depth of the directories to list next: new ones, and known ones whose stamp moved (all with deep)."""
    above = read.select(F.col("dir_id").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
    new = found.filter("action = 'add' and is_dir").select(F.col("id").alias("dir_id"), "parent", "name")
    there = seen.filter("name is not null and is_dir").select(F.col("dir_id").alias("_in"), F.col("name").alias("_name"), F.col("stamp").alias("_stamp"))
    old = base.filter("not deleted and is_dir").select(F.col("id").alias("dir_id"), "parent", "name", "stamp")
    old = old.join(there, (old["parent"] == there["_in"]) & (old["name"] == there["_name"]))
    if not deep:
        old = old.filter(~F.col("stamp").eqNullSafe(F.col("_stamp")))
    x = new.unionByName(old.select("dir_id", "parent", "name"))
    x = x.join(above, x["parent"] == above["_up"])
    return x.select("dir_id", F.concat(F.regexp_replace("_path", "/$", ""), F.lit("/"), F.col("name")).alias("path"), (F.col("_depth") + 1).cast("int").alias("depth"))
