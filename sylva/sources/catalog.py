"""The catalog: one table of file and directory entries, and what is derived from it.

A base entry has id, parent (null for a root), name (a root's is its absolute path), depth, is_dir, size,
mtime, ctime and stamp; enriched() adds the columns that searches read. Only directories are joined to build
paths: they are few next to the files, and pointer doubling takes log2(depth) joins whatever the depth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions.text import fold

BASE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("name", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("is_dir", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("ctime", T.LongType()),
    T.StructField("stamp", T.LongType()), T.StructField("deleted", T.BooleanType()),
])
BASE_COLUMNS = BASE.fieldNames()

#: The star schema's tables laid out as three trees, /data, /docs and /media; {epoch} is the order date in seconds.
STAR = """
select cast(0 as bigint) id, cast(null as bigint) parent, '/data' name, 0 depth, true is_dir, cast(4096 as bigint) size, cast(946684800 as bigint) mtime
union all select cast(1 as bigint), cast(null as bigint), '/docs', 0, true, cast(4096 as bigint), cast(946684800 as bigint)
union all select 1000000000 + r_regionkey, 0, r_name, 1, true, 4096, 946684800 from {region}
union all select 2000000000 + n_nationkey, 1000000000 + n_regionkey, n_name, 2, true, 4096, 946684800 from {nation}
union all select 3000000000 + c_custkey, 2000000000 + c_nationkey, c_name, 3, true, 4096, 946684800 from {customer}
union all select 4000000000 + o_orderkey, 3000000000 + o_custkey,
  concat(case when o_orderkey % 17 = 0 then '.' else '' end, 'order_', cast(o_orderkey as varchar(20)),
         case o_orderpriority when '1-URGENT' then '.conf' when '2-HIGH' then '.TXT' when '3-MEDIUM' then '.log' when '4-NOT SPECIFIED' then '.jpg' else '' end),
  4, false, case when o_orderkey % 13 = 0 then 0 else cast(floor(o_totalprice) as bigint) end, {epoch} from {orders}
union all select distinct 5000000000 + cast(ascii(substr(lang, 1, 1)) as bigint) * 256 + ascii(substr(lang, 2, 1)), 1, lang, 1, true, 4096, 946684800 from {documents}
union all select cast(2 as bigint), cast(null as bigint), '/media', 0, true, cast(4096 as bigint), cast(788918400 as bigint)
union all select 6000000000 + doc_id, 5000000000 + cast(ascii(substr(lang, 1, 1)) as bigint) * 256 + ascii(substr(lang, 2, 1)),
  concat('Doc-', cast(doc_id as varchar(20)), '.', source, '.md'), 2, false, n_chars, 1700000000 + doc_id * 3600 from {documents}
union all select 7000000000 + p_partkey, 2, concat('Disc:', cast(p_partkey as varchar(20)), ' ', p_brand, ' Side A',
         case p_partkey % 6 when 0 then '.mp3' when 1 then '.MKV' when 2 then '.zip' when 3 then '.exe' when 4 then '.flac' else '.7z' end),
  1, false, p_size * 1000, 788918400 + p_partkey * 60 from {part}
"""
STAR_TABLES = ("region", "nation", "customer", "orders", "documents", "part")
#: Directories that lie one in another, at most; deeper ones and those in a circle have no path.
MAX_LEVELS = 512


def star_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base entries over the star schema in sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in STAR_TABLES}
    epoch = "unix_seconds(cast(o_orderdate as timestamp))"
    text = STAR.format(epoch=epoch, **{t: f"{{{t}}}" for t in STAR_TABLES})
    base = spark.sql(text, **frames)
    return base.select("id", "parent", "name", "depth", "is_dir", "size", "mtime", (F.col("mtime") + 86400).alias("ctime"),
        (F.col("mtime") * 1_000_000_000).alias("stamp"), F.lit(False).alias("deleted"))


def entries(rows: DataFrame) -> DataFrame:
    """Base entries from any table with at least id, parent, name and is_dir."""
    have = set(rows.columns)
    defaults = {"depth": F.lit(None), "size": F.lit(0), "mtime": F.lit(0), "ctime": F.col("mtime") if "mtime" in have else F.lit(0), "stamp": F.lit(0), "deleted": F.lit(False)}
    return rows.select(*[(F.col(f.name) if f.name in have else defaults[f.name]).cast(f.dataType).alias(f.name) for f in BASE])


def live(base: DataFrame) -> DataFrame:
    return base.filter(~F.col("deleted"))


def extension(name: Column) -> Column:
    """What follows the last dot, folded; null without a dot, at a trailing dot, or if the only dot leads."""
    return F.nullif(fold(F.regexp_extract(name, r"^(?s:.+)\.([^.]{1,255})$", 1)), F.lit(""))


def stem(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)


def parent_path(path: Column) -> Column:
    cut = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(~F.contains(path, F.lit("/")), F.lit("")).when(cut == "", F.lit("/")).otherwise(cut)


def _under(above: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(above, "/$", ""), F.lit("/"), name)


def _closed(base: DataFrame, depth: int | None) -> DataFrame:
    """d, up, p, steps: each directory with its path from the highest directory reached; up is null where that is a root.

    Reach doubles from round to round. Without a depth it goes on until no directory is open, up to MAX_LEVELS.
    """
    dirs = base.filter("is_dir").select(F.col("id").alias("d"), F.col("parent").alias("up"), F.col("name").alias("p"), F.lit(0).alias("steps"))
    reach = 1
    while reach <= (MAX_LEVELS if depth is None else depth):
        if depth is None:
            dirs = storage.pinned(dirs)
            if not dirs.filter("up is not null").limit(1).count():
                break
        above = dirs.select(F.col("d").alias("ad"), F.col("up").alias("aup"), F.col("p").alias("ap"), F.col("steps").alias("asteps"))
        joined = dirs.join(above, dirs["up"] == above["ad"], "left")
        found = F.col("ad").isNotNull()
        joined = joined.filter(F.col("up").isNull() | found)
        path = F.when(found, _under(F.col("ap"), F.col("p"))).otherwise(F.col("p"))
        dirs = joined.select("d", F.col("aup").alias("up"), path.alias("p"), F.when(found, F.col("steps") + F.col("asteps") + 1).otherwise(F.col("steps")).alias("steps"))
        reach *= 2
    return dirs


def with_paths(base: DataFrame, depth: int | None = None) -> DataFrame:
    """base with its full path, depth and the parent's path; rows without a living root, in a circle of parents or
    more than MAX_LEVELS deep are dropped (unrooted() lists them).

    depth: the deepest directory's, if it is known: no rows are read ahead then, and a directory that lies deeper is an error.
    """
    dirs = _closed(base, depth)
    if depth is None:
        dirs = dirs.filter("up is null")
    else:
        dirs = dirs.filter(F.when(F.col("up").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"deeper than {depth}: "), F.col("p"))).cast("boolean")))
    dirs = dirs.select(F.col("d").alias("_d"), F.col("p").alias("_p"), F.col("steps").alias("_steps"))
    x = base.join(dirs, base["parent"] == dirs["_d"], "left").filter(F.col("parent").isNull() | F.col("_d").isNotNull())
    path = F.when(F.col("parent").isNull(), F.col("name")).otherwise(_under(F.col("_p"), F.col("name")))
    own_depth = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("_steps") + 1).cast("int")
    above = F.when(F.col("parent").isNull(), parent_path(F.col("name"))).otherwise(F.col("_p"))
    return x.select(*[own_depth.alias(c) if c == "depth" else base[c] for c in base.columns], path.alias("path"), above.alias("parent_path"))


def unrooted(base: DataFrame) -> DataFrame:
    """The rows that with_paths() drops."""
    rooted = _closed(base, None).filter("up is null").select(F.col("d").alias("_d"))
    return base.filter("parent is not null").join(rooted, base["parent"] == rooted["_d"], "left_anti")


def child_counts(base: DataFrame) -> DataFrame:
    return base.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("nchild"))


def attributes(is_dir: Column, hidden: Column) -> Column:
    """The attribute mask: directory 16, hidden 2, archive 32 on all but directories."""
    return F.when(is_dir, F.lit(16)).otherwise(F.lit(32)) + F.when(hidden, F.lit(2)).otherwise(F.lit(0))


def enriched(base: DataFrame, depth: int | None = None) -> DataFrame:
    """The living entries with all that searches read."""
    base = live(base)
    x = with_paths(base, depth)
    counts = child_counts(base).withColumnRenamed("parent", "_parent")
    x = x.join(counts, x["id"] == counts["_parent"], "left").drop("_parent")
    dname = F.substring_index("name", "/", -1)
    x = x.withColumn("nchild", F.coalesce("nchild", F.lit(0))).withColumn("dname", dname)
    x = x.withColumn("is_hidden", F.startswith("dname", F.lit(".")))
    x = x.withColumn("ext", F.when(~F.col("is_dir"), extension(F.col("dname"))))
    return x.withColumn("attributes", attributes(F.col("is_dir"), F.col("is_hidden")))


def check_schema(df: DataFrame) -> DataFrame:
    """df, if it has exactly the catalog's columns; a snapshot of another layout is refused."""
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in BASE]:
        raise ValueError(f"not a catalog of this layout: {df.schema.simpleString()}")
    return df


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def save(base: DataFrame, path: str, epoch: int | None = None) -> bool:
    """Writes the base columns as a version of the snapshot; everything else is derived again on load.

    The version is written aside and gets its name, that of the epoch, by one rename; so a failed write leaves the old
    version, and a table may be saved over the snapshot it was loaded from. The version before stays for its
    readers, older ones go. epoch: by default one more than the last; nothing is written (False) if it is there already.
    """
    spark = base.sparkSession
    there = _versions(spark, path)
    if epoch is None:
        epoch = there[-1] + 1 if there else 0
    if epoch in there:
        return False
    aside = f"{path}/_new-{uuid.uuid4().hex}"
    base.select(*BASE_COLUMNS).write.parquet(aside)
    at, fs = _fs(spark, aside)
    if not fs.rename(at, _fs(spark, f"{path}/v={epoch}")[0]):
        raise OSError(f"cannot name {aside} version {epoch}")
    for old in [v for v in there if v < epoch][:-1]:
        fs.delete(_fs(spark, f"{path}/v={old}")[0], True)
    return True


def saved_epoch(spark: SparkSession, path: str) -> int | None:
    """The epoch of a snapshot's last version."""
    return max(_versions(spark, path), default=None)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a snapshot, or the table at path itself."""
    epoch = saved_epoch(spark, path)
    return check_schema(spark.read.parquet(path if epoch is None else f"{path}/v={epoch}"))


def materialise(entries: DataFrame, path: str) -> None:
    """Writes enriched entries in order of their parent's path: a directory's children lie together, and a search by
    parent, size, date or extension reads only the row groups whose ranges meet it."""
    entries.repartitionByRange("parent_path", "id").sortWithinPartitions("parent_path", "id").write.mode("overwrite").parquet(path)


def roots(base: DataFrame) -> DataFrame:
    """The locations that a catalog covers, in id order."""
    return live(base).filter("parent is null").select("id", "name").orderBy("id")


def overlapping_roots(paths: DataFrame) -> DataFrame:
    """Pairs of a table of root paths (column path) of which one is the other or lies in it; of rows of one path, each
    pairs with the others. Rows are told apart by path and number: ids made as they are read change when they are read again."""
    n = paths.groupBy("path").agg(F.count("*").cast("int").alias("n"))
    n = n.withColumn("bare", F.rtrim("path", F.lit("/")))
    # every prefix that ends at a component meets the roots of that name by an equality join
    parts = F.split("bare", "/")
    above = n.select("path", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("prefix"))
    o = n.select(F.col("path").alias("outer"), F.col("n").alias("others"), F.col("bare").alias("prefix"))
    pairs = above.join(o, "prefix").withColumn("others", F.col("others") - F.when(F.col("path") == F.col("outer"), 1).otherwise(0))
    pairs = pairs.select("path", "outer", "others", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    return pairs.select("path", "outer", F.explode(F.array_repeat(F.lit(0), F.col("others")))).select("path", "outer")
