"""Keeping a catalog fresh: reconcile with listings, sweep, delta log, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..sources.catalog import MAX_LEVELS
from . import ordering

ATTRIBUTES = ("size", "mtime", "ctime")


def reconcile(base: DataFrame, listing: DataFrame, dirty: DataFrame, deep: bool = False) -> DataFrame:
    """The changes that fresh listings of dirty directories call for.

    listing: dir_id, name, is_dir, size, mtime, ctime, stamp; dirty: dir_id. Entries are known by name: one
    that turns from file to directory or back is removed and added. A names pass looks at names and at
    directories alone; a deep one compares the attributes of files too. Result: action (add, remove, touch), id
    (null for add), parent, name and the listed attributes. Applying a listing twice changes nothing.
    """
    dirs = dirty.select(F.col("dir_id").alias("_dir")).distinct()
    known = base.filter(~F.col("deleted")).join(dirs, F.col("parent") == F.col("_dir"), "left_semi")
    k = known.select(F.col("id"), F.col("parent").alias("kp"), F.col("name").alias("kn"), F.col("is_dir").alias("kd"), *[F.col(c).alias(f"k_{c}") for c in (*ATTRIBUTES, "stamp")])
    seen = listing.join(dirs, listing["dir_id"] == F.col("_dir"), "left_semi")
    x = k.join(seen, (k["kp"] == seen["dir_id"]) & (k["kn"] == seen["name"]), "full_outer")
    other = F.lit(False)
    for c in ATTRIBUTES:
        other = other | (F.col(f"k_{c}") != F.col(c))
    moved = other | (F.col("is_dir") & (F.col("k_stamp") != F.col("stamp")))
    if not deep:
        moved = F.col("is_dir") & moved
    actions = F.when(F.col("id").isNull(), F.array(F.lit("add"))).when(F.col("dir_id").isNull(),
        F.array(F.lit("remove"))).when(F.col("kd") != F.col("is_dir"), F.array(F.lit("remove"), F.lit("add"))).when(moved,
        F.array(F.lit("touch"))).otherwise(F.array().cast("array<string>"))
    x = x.select(F.explode(actions).alias("action"), "id", F.coalesce("kp", "dir_id").alias("parent"), F.coalesce("kn", "name").alias("name"), "is_dir", *ATTRIBUTES, "stamp")
    return x.withColumn("id", F.when(F.col("action") != "add", F.col("id")))


def subtree(base: DataFrame, ids: DataFrame, levels: int = MAX_LEVELS) -> DataFrame:
    """id: the given entries (column id) and all that lies below them.

    Only directories are followed: each learns in log2(levels) joins whether one over it is given. Rows in a circle of
    parents are followed up to `levels` too.
    """
    live = base.filter(~F.col("deleted"))
    given = ids.select(F.col("id").alias("_given")).distinct()
    dirs = live.filter("is_dir").join(given, F.col("id") == F.col("_given"), "left")
    dirs = dirs.select(F.col("id").alias("d"), F.when(F.col("_given").isNull(), F.col("parent")).alias("up"), F.col("_given").isNotNull().alias("hit"))
    reach = 1
    while reach <= levels:
        dirs = storage.pinned(dirs)
        if not dirs.filter("up is not null").limit(1).count():
            break
        above = dirs.select(F.col("d").alias("ad"), F.col("up").alias("aup"), F.col("hit").alias("ahit"))
        hit = F.col("hit") | F.coalesce("ahit", F.lit(False))
        dirs = dirs.join(above, dirs["up"] == above["ad"], "left").select("d", F.when(~hit, F.col("aup")).alias("up"), hit.alias("hit"))
        reach *= 2
    below = live.join(dirs.filter("hit").select("d"), F.col("parent") == F.col("d"), "left_semi").select("id")
    return ids.select("id").union(below).distinct()


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base after the changes: removed subtrees become tombstones, added entries without an id get new ones, in order of
    parent and name. Entries added below added ones have the ids given (update() gives them)."""
    gone = subtree(base, changes.filter("action = 'remove'")).select(F.col("id").alias("_gone"))
    touch = changes.filter("action = 'touch'").select(F.col("id").alias("_touch"), *[F.col(c).alias(f"t_{c}") for c in (*ATTRIBUTES, "stamp")])
    x = base.join(gone, base["id"] == gone["_gone"], "left").join(touch, base["id"] == touch["_touch"], "left")
    x = x.select(*[F.coalesce(f"t_{c}", c).alias(c) if c in (*ATTRIBUTES,
        "stamp") else (F.col("deleted") | F.col("_gone").isNotNull()).alias(c) if c == "deleted" else base[c] for c in base.columns])
    last = base.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    added = changes.filter("action = 'add'").select(F.col("id").alias("_own"), "parent", "name", "is_dir", *ATTRIBUTES, "stamp")
    above = base.select(F.col("id").alias("_up"), F.col("depth").alias("_depth"))
    fresh = ordering.positions(added.filter("_own is null"), [F.col("parent"), F.col("name")], name="_n").crossJoin(F.broadcast(last))
    fresh = fresh.withColumn("id", F.col("last") + F.col("_n")).drop("_own", "_n", "last")
    added = fresh.unionByName(added.filter("_own is not null").withColumnRenamed("_own", "id"))
    added = added.join(above, added["parent"] == above["_up"], "left")
    added = added.select("id", "parent", "name", (F.col("_depth") + 1).cast("int").alias("depth"), "is_dir", *ATTRIBUTES, "stamp", F.lit(False).alias("deleted"))
    return x.unionByName(added.select(*base.columns))


def epoch_after(epoch: int, changes: DataFrame) -> DataFrame:
    """epoch: one more if a query could answer differently (an entry came, went, or an attribute was touched)."""
    return changes.agg((F.lit(epoch) + F.when(F.count("*") > 0, 1).otherwise(0)).alias("epoch"))


def sweep(base: DataFrame, stamps: DataFrame) -> DataFrame:
    """dir_id: directories whose stamp is not the one that was kept (stamps: id, stamp)."""
    s = stamps.select(F.col("id").alias("_id"), F.col("stamp").alias("_stamp"))
    return base.filter("is_dir and not deleted").join(s, F.col("id") == F.col("_id")).filter(F.col("stamp") != F.col("_stamp")).select(F.col("id").alias("dir_id"))


def last_writes(delta: DataFrame) -> DataFrame:
    """The last row by seq of each id of a change log (seq, id, value, retract)."""
    w = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return delta.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merged(main: DataFrame, delta: DataFrame) -> DataFrame:
    """id, value: main with the change log's last word on each id."""
    last = delta.groupBy("id").agg(F.max_by(F.struct("value", "retract"), "seq").alias("w"))
    kept = main.join(last, "id", "left_anti").select("id", "value")
    return kept.unionByName(last.filter(~F.col("w.retract")).select("id", F.col("w.value").alias("value")))


def wants_merge(main: DataFrame, delta: DataFrame, idle_seconds: float = 0.0, share: float = 0.01, idle: float = 60.0) -> DataFrame:
    """wanted: whether a change log is to be merged: over a share of the main table, or not empty and idle for so long."""
    rows = delta.agg(F.count("*").alias("d")).crossJoin(main.agg(F.count("*").alias("m")))
    return rows.select(((F.col("d") > F.col("m") * share) | ((F.col("d") > 0) & F.lit(idle_seconds > idle))).alias("wanted"))


def compacted(base: DataFrame) -> DataFrame:
    """base without tombstones, ids dense and in the old order, parents renamed with them."""
    kept = base.filter(~F.col("deleted"))
    ids = ordering.positions(kept.select(F.col("id").alias("old")), [F.col("old")], name="new", first=0)
    own = ids.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
    up = ids.select(F.col("old").alias("_uo"), F.col("new").alias("_un"))
    x = kept.join(own, kept["id"] == own["_o"]).join(up, kept["parent"] == up["_uo"], "left")
    return x.select(*[F.col("_n").alias("id") if c == "id" else F.col("_un").alias("parent") if c == "parent" else kept[c] for c in base.columns])


def wants_compaction(base: DataFrame, least: int = 1024, share: float = 0.25) -> DataFrame:
    """wanted: whether tombstones are over a share of at least so many ids."""
    return base.agg(((F.count("*") >= least) & (F.count_if("deleted") > F.count("*") * share)).alias("wanted"))


def roots_changed(covered: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, change (added or dropped): how the wanted root paths differ from those that are covered."""
    c, w = covered.select("name").distinct(), wanted.select("name").distinct()
    return w.exceptAll(c).withColumn("change", F.lit("added")).unionByName(c.exceptAll(w).withColumn("change", F.lit("dropped")))
