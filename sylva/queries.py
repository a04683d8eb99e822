"""The registered catalog queries over the star schema's three trees, each with SQL that gives the same rows."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions.extensions import ARCHIVE, AUDIO, DOCUMENT, EXECUTABLE, IMAGE, VIDEO
from .functions.text import resolve_path as resolved
from .operators import aggregates, incremental, ordering, output, sets, trigrams, update
from .operators.leaves import Context
from .operators.search import Filter, search
from .plans.compiler import matches
from .plans.options import skipped
from .sources import catalog, files
from .streaming import events as ev

#: The moment that relative dates are read against.
NOW = 1_704_067_200
#: Depth of the deepest directory of the star schema's trees.
STAR_DEPTH = 3
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BASE = catalog.STAR.format(epoch="epoch_us(o_orderdate) // 1000000", **{t: t for t in catalog.STAR_TABLES})
#: DuckDB: the same catalog, by a recursion from the roots down.
E = f"""with recursive b0 as ({_BASE}),
b as (select id, parent, name, is_dir, size, mtime, mtime + 86400 as ctime, mtime * 1000000000 as stamp from b0),
p(id, path, parent_path, depth) as (
  select id, name, case when name like '/%/%' then regexp_replace(name, '/[^/]*$', '') else '/' end, 0 from b where parent is null
  union all select b.id, p.path || '/' || b.name, p.path, p.depth + 1 from b join p on b.parent = p.id),
n as (select parent as np, count(*) as nchild from b where parent is not null group by parent),
e0 as (select b.*, p.path, p.parent_path, p.depth, coalesce(n.nchild, 0) as nchild, split_part(b.name, '/', -1) as dname
  from b join p on b.id = p.id left join n on n.np = b.id),
e as (select *, dname like '.%' as is_hidden, case when not is_dir then nullif({FOLD.format("regexp_extract(dname, '^.+\\.([^.]{1,255})$', 1)")}, '') end as ext,
  case when is_dir then 16 else 32 end + case when dname like '.%' then 2 else 0 end as attributes, {FOLD.format("dname")} as fname, {FOLD.format("path")} as fpath from e0)
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.enriched(catalog.star_catalog(spark, sf_dir), STAR_DEPTH)


def _sql_in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: Searches by key: the search string and the SQL condition on e that it stands for.
SEARCHES = {
    "parent_path": ('parent:"/data/ASIA"', "parent is not null and parent_path = '/data/ASIA'"),
    "parent_root_union": ('parent:""', "parent in (0, 1, 2)"),
    "root": ("root:", "depth = 1"),
    "depth": ("depth:>=2 depth:<4", "depth >= 2 and depth < 4"),
    "child_count": ("child-count:>3", "nchild > 3"),
    "empty": ("empty:", "case when is_dir then nchild = 0 else size = 0 end"),
    "file": ("file:", "not is_dir"),
    "folder": ("folder:", "is_dir"),
    "ext_eq": ("ext:conf", "ext = 'conf'"),
    "list_semicolon": ("ext:conf;txt,log", "ext in ('conf', 'txt', 'log')"),
    "size_cmp": ("size:>=100000 file:", "size >= 100000 and not is_dir"),
    "size_range": ("size:1000..50000", "size between 1000 and 50000"),
    "size_dash_range": ("size:1000-50000", "size between 1000 and 50000"),
    "size_not": ("size:!=4096", "size <> 4096"),
    "size_units": ("size:>1.5kb size:<100k", "size > 1500 and size < 102400"),
    "size_const": ("size:small", "size > 10240 and size <= 102400"),
    "range_on_column": ("size:<=0 file:", "size <= 0 and not is_dir"),
    "dm_cmp": ("dm:>1997-06-01", "mtime > 865123200"),
    "dm_range": ("dm:1995..1996", "mtime between 788918400 and 852076799"),
    "dc_cmp": ("dc:<1996", "ctime < 820454400"),
    "date_literals": ("dm:1995-03 | dm:>30d | dm:19960102 | dm:1994/02",
    "mtime between 794016000 and 796694399 or mtime > 1704067200 - 30 * 86400 or mtime = 820540800 or mtime between 760060800 and 760060800 + 31 * 86400 - 1"),
    "attrib": ("attrib:h", "is_hidden"),
    "attrib_not": ("attrib:!d", "not is_dir"),
    "len": ("len:10", "octet_length(encode(name)) = 10"),
    "macro_image": ("image:", f"ext in {_sql_in(IMAGE)}"),
    "macro_doc": ("doc:", f"ext in {_sql_in(DOCUMENT)}"),
    "macro_audio": ("audio:", f"ext in {_sql_in(AUDIO)}"),
    "macro_video": ("video:", f"ext in {_sql_in(VIDEO)}"),
    "macro_archive": ("archive:", f"ext in {_sql_in(ARCHIVE)}"),
    "macro_exe": ("exe:", f"ext in {_sql_in(EXECUTABLE)}"),
"type": ("type:picture", f"ext in {_sql_in(IMAGE)}"),
    "op_and": ("ext:jpg size:>100000 depth:4", "ext = 'jpg' and size > 100000 and depth = 4"),
    "op_or": ("ext:conf | size:0 | folder:", "ext = 'conf' or size = 0 or is_dir"),
    "op_not": ("!ext:conf file:", "(ext <> 'conf' or ext is null) and not is_dir"),
    "op_group": ("file: <ext:conf | ext:log> !<size:>100000>", "not is_dir and ext in ('conf', 'log') and not size > 100000"),
    "op_match_all": ("", "true"),
    "list_and": ("size:<>1000 <90000>", "size > 1000 and size < 90000"),
    "list_or": ("ext:<conf | jpg>", "ext in ('conf', 'jpg')"),
    "fn_unknown": ("disc:1", "contains(fname, 'disc:1')"),
    "fn_unsupported": ("content:order | folder:", "is_dir"),
    "text_substr": ("ORDER_11", "contains(fname, 'order_11')"),
    "text_path": ("path:asia/nation_2", "contains(fpath, 'asia/nation_2')"),
    "text_separator": ("EUROPE\\\\nation_3", "contains(fpath, 'europe/nation_3')"),
    "text_stem": ("stem:doc-1", "contains(case when regexp_matches(fname, '^.+\\.[^.]*$') then regexp_extract(fname, '^(.+)\\.[^.]*$', 1) else fname end, 'doc-1')"),
    "text_whole": ("whole:NATION_2", "dname = 'NATION_2'"),
    "text_startwith": ("startwith:Customer", "starts_with(fname, 'customer')"),
    "text_endwith": ("endwith:.TXT", "ends_with(fname, '.txt')"),
    "text_prefix": ("prefix:doc", "regexp_matches(fname, '^doc($|[^a-z0-9\\x{80}-\\x{10FFFF}])')"),
    "text_suffix": ("suffix:md", "regexp_matches(fname, '(^|[^a-z0-9\\x{80}-\\x{10FFFF}])md$')"),
    "text_ww": ("ww:order", "regexp_matches(fname, '(^|[^a-z0-9\\x{80}-\\x{10FFFF}])order($|[^a-z0-9\\x{80}-\\x{10FFFF}])')"),
    "text_case": ("case:TXT", "contains(dname, 'TXT')"),
    "text_ignorepunc": ("ignorepunc:order12", "contains(regexp_replace(fname, '[[:punct:]]', '', 'g'), 'order12')"),
    "text_ignorews": ("ignorews:brand#1sidea", "contains(regexp_replace(fname, '\\s', '', 'g'), 'brand#1sidea')"),
    "text_diacritics": ("diacritics:Örder_1", "contains(fname, 'order_1')"),
    "text_wildcard_name": ("order_?#.*", "regexp_matches(fname, '^order_[^/\\\\][0-9]\\.[^/\\\\]*$')"),
    "text_wildcard_path": ("asia/*/customer*", "regexp_matches(fpath, '(^|/)asia/[^/\\\\]*/customer[^/\\\\]*$')"),
    "text_wildcard_set": ("doc-[1-3]?.*", "regexp_matches(fname, '^doc-[1-3][^/\\\\]\\.[^/\\\\]*$')"),
    "text_regex": ('regex:"^order_[0-9]+5\\.(conf|log)$"', "regexp_matches(fname, '^order_[0-9]+5\\.(conf|log)$')"),
    "text_regex_nested": ('regex:"^(order|disc)(_|:)([0-9]+)*[05][.]"', "regexp_matches(fname, '^(order|disc)(_|:)([0-9]+)*[05][.]')"),
    "text_entities": ("&sp;side&sp;a.mp3 | order_1&excl;", "contains(fname, ' side a.mp3') or contains(fname, 'order_1!')"),
    "text_regex_path": ('path:regex:"/(fr|de)/Doc-1"', "regexp_matches(fpath, '/(fr|de)/doc-1')"),
    "child": ('child:"ext:jpg size:>300000"', "id in (select parent from e where ext = 'jpg' and size > 300000)"),
    "child_or": ('child:"ext:conf" !child:"size:0" | ext:log',
    "(id in (select parent from e where ext = 'conf') and id not in (select parent from e where size = 0 and parent is not null)) or coalesce(ext = 'log', false)"),
    "join_child_semi": ('folder: child:"child:ext:jpg"', "is_dir and id in (select parent from e where id in (select parent from e where ext = 'jpg'))"),
}

#: Orders by key: the sort name, the SQL order.
SORTS = {
    "sort_name": ("name_ascending", "fname, id"), "sort_path": ("path_ascending", "fpath, fname, id"),
    "sort_file_list_filename": ("file_list_filename_descending", "fpath desc, fname desc, id desc"),
    "sort_size": ("size_descending", "size desc, id desc"), "sort_mtime": ("date_modified_ascending", "mtime, id"),
    "sort_ctime": ("date_created_descending", "ctime desc, id desc"),
    "sort_ext": ("extension_ascending", "coalesce(ext, ''), fname, id"), "sort_attributes": ("attributes_ascending", "attributes, id"),
    "sort_recently_changed": ("date_recently_changed_descending", "mtime desc, id desc"),
    "sort_inverse_size": ("inverse_size_ascending", "size, id"), "sort_desc": ("name_descending", "fname desc, id desc"),
}


def _search_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: matches(entries(spark, sf_dir), text, Context(now=NOW)).select("id", "path")


def _sort_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: search(entries(spark, sf_dir), "file: | depth:<3", sort=name).positions().select("id", "pos")


def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: a directory's folders by name, the first 200."""
    r = search(entries(spark, sf_dir), 'parent:"/data/ASIA" folder:', sort="name_ascending", count=200)
    return output.project(r.page(), ("path", "size", "attributes"), keep=("id",))


def limit_offset(spark, sf_dir):
    return search(entries(spark, sf_dir), "ext:conf", sort="size_descending", offset=20, count=50).page().select("id", "size")


def topk(spark, sf_dir):
    return search(entries(spark, sf_dir), "file:", sort="size_descending", count=100).page().select("id", "size")


def result_count(spark, sf_dir):
    return search(entries(spark, sf_dir), "ext:conf | folder:").counts()


def filter_stage2(spark, sf_dir):
    return search(entries(spark, sf_dir), "ext:conf", filter=Filter("_1", frozenset({"case"}))).matched.select("id", "path")


def date_periods(spark, sf_dir):
    """Named periods seen from 8 December 2023."""
    ctx = Context(now=1_702_000_000)
    return matches(entries(spark, sf_dir), "dm:lastmonth | dm:thismonth | dm:yesterday | dm:ytd", ctx).select("id", "path")


def match_options(spark, sf_dir):
    """A session's whole-word option applies to bare terms, not to those with an option of their own."""
    ctx = Context(now=NOW, options=frozenset({"ww"}))
    return matches(entries(spark, sf_dir), "order | startwith:Doc-1", ctx).select("id")


def columns_7(spark, sf_dir):
    return output.project(matches(entries(spark, sf_dir), "depth:<4"), output.COLUMNS, keep=("id",))


def col_path(spark, sf_dir):
    return entries(spark, sf_dir).select("id", output.column("path"))


def col_full_path(spark, sf_dir):
    return entries(spark, sf_dir).select("id", output.column("file_list_filename"))


def col_attributes(spark, sf_dir):
    return entries(spark, sf_dir).select("id", "attributes")


def col_filetime(spark, sf_dir):
    return entries(spark, sf_dir).select("id", output.column("date_modified"), output.column("date_created"), output.column("date_recently_changed"))


def col_size_sentinel(spark, sf_dir):
    return entries(spark, sf_dir).select("id", output.column("size"))


def wire_block(spark, sf_dir):
    return output.result_lines(matches(entries(spark, sf_dir), "ext:conf size:>200000"), ("path", "size")).select("line")


def cli_print(spark, sf_dir):
    return output.listing_lines(matches(entries(spark, sf_dir), "ext:log size:>200000"))


def list_dir(spark, sf_dir):
    return output.list_directory(entries(spark, sf_dir), "/docs/en").select("id", "name", "size")


def tombstone_filter(spark, sf_dir):
    base = catalog.star_catalog(spark, sf_dir)
    base = base.withColumn("deleted", ~F.col("is_dir") & (F.col("id") % 5 == 0))
    return matches(catalog.enriched(base, STAR_DEPTH), "file:").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def roots_list(spark, sf_dir):
    return catalog.roots(catalog.star_catalog(spark, sf_dir))


def roots_validate(spark, sf_dir):
    """Every directory of the first two levels given as a root: each lies in what is over it."""
    paths = entries(spark, sf_dir).filter("is_dir and depth < 2 and path <> '/data'").select("path")
    more = spark.createDataFrame([("/data/",), ("/data",), ("/database",)], "path string")
    return catalog.overlapping_roots(paths.union(more))


def index_finalize(spark, sf_dir):
    return entries(spark, sf_dir).select("id", "path", "parent_path", "depth", "nchild", "ext", "attributes", "is_hidden")


def join_path(spark, sf_dir):
    return catalog.with_paths(catalog.star_catalog(spark, sf_dir), STAR_DEPTH).select("id", "path", "depth")


def join_children(spark, sf_dir):
    base = catalog.star_catalog(spark, sf_dir)
    up = base.filter("is_dir").select(F.col("id").alias("dir_id"), F.col("name").alias("dir_name"))
    return base.join(up, base["parent"] == up["dir_id"]).select("dir_id", "dir_name", "id", "name")


def agg_child_count(spark, sf_dir):
    return catalog.child_counts(catalog.star_catalog(spark, sf_dir))


def agg_ext_cardinality(spark, sf_dir):
    return aggregates.ext_cardinality(entries(spark, sf_dir))


def agg_ext_histogram(spark, sf_dir):
    return aggregates.cardinality_histogram(entries(spark, sf_dir))


def agg_distinct_names(spark, sf_dir):
    return aggregates.distinct_names(catalog.star_catalog(spark, sf_dir))


def agg_type_split(spark, sf_dir):
    return aggregates.type_split(entries(spark, sf_dir))


def agg_result_counts(spark, sf_dir):
    return search(entries(spark, sf_dir), "ext:conf;log | depth:<4").counts()


def scan_stats(spark, sf_dir):
    return aggregates.scan_stats(entries(spark, sf_dir))


def win_dense_rank(spark, sf_dir):
    return aggregates.name_ranks(entries(spark, sf_dir))


def win_rank_gap(spark, sf_dir):
    return aggregates.ranks_below(entries(spark, sf_dir), ["asia", "doc-5", "order_2", "zzz", ""])


def trigram_index(spark, sf_dir):
    return trigrams.cardinality(entries(spark, sf_dir))


def trigram_postings(spark, sf_dir):
    return trigrams.postings(entries(spark, sf_dir).filter("depth < 4"))


def text_trigram(spark, sf_dir):
    e = entries(spark, sf_dir)
    return trigrams.containing(e, trigrams.postings(e), "DER_12").select("id", "path")


def index_skip(spark, sf_dir):
    """Without the trigram index the same search has the same answer."""
    e = entries(spark, sf_dir)
    uses = skipped(flag="trigram").uses("trigram")
    found = trigrams.containing(e, trigrams.postings(e), "DER_12") if uses else matches(e, "DER_12")
    return found.select("id", "path")


def set_union_roots(spark, sf_dir):
    return sets.top_levels(entries(spark, sf_dir)).select("id", "path")


def set_bitmap_ops(spark, sf_dir):
    e = entries(spark, sf_dir)
    a, b = matches(e, "ext:conf"), matches(e, "size:>200000")
    tagged = lambda df, op: df.select(F.lit(op).alias("op"), "id")
    return tagged(sets.union(a, b), "union").union(tagged(sets.intersection(a, b), "intersect")).union(tagged(sets.difference(a, b), "except"))


def _delta(spark, sf_dir):
    """A change log over entries: sizes of orders, some later retracted, from the line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return items.select(seq.alias("seq"), (F.lit(4000000000) + F.col("l_orderkey")).alias("id"),
        F.floor("l_extendedprice").cast("long").alias("value"), (F.col("l_linenumber") % 5 == 4).alias("retract"))


def win_last_write(spark, sf_dir):
    return incremental.last_writes(_delta(spark, sf_dir))


def delta_merge(spark, sf_dir):
    main = catalog.star_catalog(spark, sf_dir).filter("not is_dir").select("id", F.col("size").alias("value"))
    return incremental.merged(main, _delta(spark, sf_dir))


def delta_read(spark, sf_dir):
    return delta_merge(spark, sf_dir).filter("value between 10000 and 20000")


def _listing(spark, sf_dir):
    """Fresh listings of the customers whose key is a multiple of 3: some orders gone, new, grown, or now directories."""
    base = catalog.star_catalog(spark, sf_dir)
    dirty = base.filter("depth = 3 and id % 3 = 0").select(F.col("id").alias("dir_id"))
    known = base.filter("depth = 4 and id % 7 <> 0").join(dirty, F.col("parent") == F.col("dir_id"))
    flip = F.col("id") % 11 == 0
    kept = known.select("dir_id", "name", flip.alias("is_dir"), (F.col("size") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("size"), "mtime", "ctime", "stamp")
    new = dirty.select("dir_id", F.concat(F.lit("new_"), F.col("dir_id").cast("string")).alias("name"), F.lit(False).alias("is_dir"),
        F.lit(7).cast("long").alias("size"), *[F.lit(NOW).cast("long").alias(c) for c in ("mtime", "ctime", "stamp")])
    return base, kept.unionByName(new), dirty


def join_reconcile(spark, sf_dir):
    return incremental.reconcile(*_listing(spark, sf_dir), deep=True).select("action", "id", "parent", "name")


def reconcile_names(spark, sf_dir):
    return incremental.reconcile(*_listing(spark, sf_dir)).select("action", "id", "parent", "name")


def apply_changes(spark, sf_dir):
    base, listing, dirty = _listing(spark, sf_dir)
    done = incremental.apply_changes(base, incremental.reconcile(base, listing, dirty, deep=True))
    return done.filter("not deleted").select("parent", "name", "is_dir", "size")


def join_sweep(spark, sf_dir):
    base = catalog.star_catalog(spark, sf_dir)
    stamps = base.select("id", (F.col("stamp") + F.when(F.col("id") % 4 == 1, 1).otherwise(0)).alias("stamp"))
    return incremental.sweep(base, stamps)


def closure_subtree(spark, sf_dir):
    base = catalog.star_catalog(spark, sf_dir)
    return incremental.subtree(base, base.filter("name = 'NATION_2' or name = 'de'").select("id"))


def compact(spark, sf_dir):
    base = catalog.star_catalog(spark, sf_dir)
    return incremental.compacted(base.withColumn("deleted", ~F.col("is_dir") & (F.col("id") % 3 == 0))).select("id", "parent", "name")


def reconcile_deep(spark, sf_dir):
    """The touches of a deep pass with the attributes that they bring."""
    return incremental.reconcile(*_listing(spark, sf_dir), deep=True).filter("action = 'touch'").select("id", "parent", "name", "size")


def delta_due(spark, sf_dir):
    main = catalog.star_catalog(spark, sf_dir).filter("not is_dir").select("id", F.col("size").alias("value"))
    return incremental.wants_merge(main, _delta(spark, sf_dir).filter("id % 50 = 0"))


def locations_reload(spark, sf_dir):
    """The wanted roots are the regions' directories and /docs."""
    wanted = entries(spark, sf_dir).filter("path = '/docs' or parent = 0").select(F.col("path").alias("name"))
    return incremental.roots_changed(catalog.roots(catalog.star_catalog(spark, sf_dir)), wanted)


def epoch(spark, sf_dir):
    return incremental.epoch_after(7, incremental.reconcile(*_listing(spark, sf_dir)))


def snapshot_load(spark, sf_dir):
    """The catalog after it was saved twice, the second time over the snapshot it was loaded from."""
    at = f"{storage.shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    catalog.save(catalog.star_catalog(spark, sf_dir), at, 1)
    catalog.save(catalog.load(spark, at).filter("id % 7 <> 3 or is_dir"), at, 2)
    return catalog.load(spark, at).select("id", "parent", "name", "size", "mtime")


def roots_file(spark, sf_dir):
    """The regions' directories as a file of roots, with a comment."""
    at = f"{storage.shared_dir(spark)}/roots-{uuid.uuid4().hex}"
    lines = entries(spark, sf_dir).filter("parent = 0").select(F.col("path").alias("value"))
    lines.union(spark.createDataFrame([("# the regions",), ("",)], "value string")).coalesce(1).write.text(at)
    return files.roots_file(spark, at)


def sort_names(spark, sf_dir):
    """Every sort's name with the id that comes first in its order among the orders."""
    e = entries(spark, sf_dir).filter("not is_dir and depth = 4")
    first = []
    for name in sorted(ordering.SORT_NAMES):
        columns, ascending = ordering.sort_key(name.upper())
        best = (F.min if ascending else F.max)(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]))
        first.append(F.struct(F.lit(name).alias("sort"), best[f"c{len(columns) - 1}"].alias("id")))
    return e.agg(F.array(*first).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def resolve_path(spark, sf_dir):
    """Where `cd` leads from each region's directory."""
    e = entries(spark, sf_dir).filter("parent = 0").select("id", "path").orderBy("id").collect()
    return spark.createDataFrame([(r.id, step, resolved(r.path, step)) for r in e for step in ("..", ".", "x/../y", "..\\AFRICA//", "/docs/./de")],
        "id long, step string, path string")


def _tree(spark, sf_dir) -> str:
    """A file tree on shared storage, as the driver sees it: a directory for each region, a file for each of its nations."""
    at = f"{re.sub('^file:(//)?', '', storage.shared_dir(spark))}/tree-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"),
        F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey").collect()
    for r in rows:
        os.makedirs(f"{at}/{r.r_name}/in", exist_ok=True)
        with open(f"{at}/{r.r_name}/in/{r.n_name}", "w") as f:
            f.write("x" * r.n_nationkey)
    return at


def _relative(base: DataFrame, at: str) -> DataFrame:
    x = catalog.with_paths(catalog.live(base)).select(F.substring("path", len(at) + 1, 4096).alias("path"), "depth", "is_dir",
        F.when(~F.col("is_dir"), F.col("size")).alias("size"))
    return x


def scan_tree(spark, sf_dir):
    at = _tree(spark, sf_dir)
    return _relative(files.scan(spark, [at]), at)


def update_tree(spark, sf_dir):
    """A names pass with a sweep, then a deep one, after nations of an even key went, grew by one byte at key 1 and one came."""
    at = _tree(spark, sf_dir)
    base = storage.pinned(update.build(spark, [at]))
    keys = {r.n_name: r.n_nationkey for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    for region in os.listdir(at):
        for name in os.listdir(f"{at}/{region}/in"):
            if keys[name] % 2 == 0:
                os.unlink(f"{at}/{region}/in/{name}")
            elif keys[name] == 1:
                with open(f"{at}/{region}/in/{name}", "a") as f:
                    f.write("y")
        os.makedirs(f"{at}/{region}/new/below")
    base = storage.pinned(update.update(base, sweep=True).base)
    return _relative(update.update(base, deep=True).base, at)


def _events(spark, sf_dir):
    """Change events from the events table: an order file of the user's customer directory."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    dirs = catalog.with_paths(catalog.star_catalog(spark, sf_dir), STAR_DEPTH).filter("depth = 3").select((F.col("id") - 3000000000).alias("user_id"), F.col("path").alias("dir"))
    x = e.join(dirs, "user_id", "left")
    kind = F.expr("case event_type when 'signup' then 'create' when 'error' then 'delete' when 'purchase' then 'moved' else 'attribute' end")
    at = F.concat(F.coalesce("dir", F.concat(F.lit("/elsewhere/"), F.col("user_id").cast("string"))), F.lit("/order_"), F.col("event_id").cast("string"))
    return x.select(F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), at.alias("path"),
        F.when(kind == "moved", F.concat(F.lit("/docs/en/old_"), F.col("event_id").cast("string"))).alias("old_path"))


def ev_parent_dir(spark, sf_dir):
    return ev.touched_paths(_events(spark, sf_dir)).groupBy("dir").agg(F.count("*").alias("marks"))


def ev_prefix(spark, sf_dir):
    return ev.under_roots(ev.touched_paths(_events(spark, sf_dir)), ["/data/ASIA", "/do"]).groupBy("dir").agg(F.count("*").alias("marks"))


def ev_dedup(spark, sf_dir):
    dirs = entries(spark, sf_dir).filter("is_dir").select("id", "path")
    return ev.dirty_directories(_events(spark, sf_dir), dirs, ["/data", "/docs"])


def ev_loss(spark, sf_dir):
    return ev.lost(_events(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "delete", F.lit("overflow")).otherwise(F.col("kind"))))


def ev_coalesce(spark, sf_dir):
    return ev.coalesced(_events(spark, sf_dir), "10 minutes").select(F.unix_micros("begin").alias("begin_us"), "marks", "dirs")


OTHERS = (
    trigram_postings, text_trigram, index_skip, reconcile_deep, delta_due, snapshot_load, roots_file, sort_names, resolve_path, scan_tree, update_tree,
    date_periods, browse, limit_offset, topk, result_count, filter_stage2, match_options, columns_7, col_path, col_full_path, col_attributes,
    col_filetime, col_size_sentinel, wire_block, cli_print, list_dir, tombstone_filter, roots_list, roots_validate,
    index_finalize, join_path, join_children, agg_child_count, agg_ext_cardinality, agg_ext_histogram, agg_distinct_names, agg_type_split,
    agg_result_counts, scan_stats, win_dense_rank, win_rank_gap, trigram_index, set_union_roots,
    set_bitmap_ops, win_last_write, delta_merge, delta_read, join_reconcile, reconcile_names, apply_changes, join_sweep, closure_subtree, compact,
    locations_reload, epoch, ev_parent_dir, ev_prefix, ev_dedup, ev_loss, ev_coalesce,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: _search_query(text) for k, (text, _) in SEARCHES.items()}
    found |= {k: _sort_query(name) for k, (name, _) in SORTS.items()}
    return found | {f.__name__: f for f in OTHERS}


_FILETIME = "({0} + 11644473600) * 10000000"
_COLUMNS = f"""parent_path as path, attributes, case when is_dir then '18446744073709551615' else cast(size as varchar) end as size, {_FILETIME.format("mtime")} as date_modified,
  {_FILETIME.format("ctime")} as date_created, path as file_list_filename, {_FILETIME.format("mtime")} as date_recently_changed"""
_KIND = "case when is_dir then 'FOLDER' else 'FILE' end as kind, dname as name"
_DELTA = "select l_orderkey * 10 + l_linenumber as seq, 4000000000 + l_orderkey as id, cast(floor(l_extendedprice) as bigint) as value, l_linenumber % 5 = 4 as retract from (select l_orderkey, l_linenumber, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2)"
_LAST = f"select seq, id, value, retract from (select *, row_number() over (partition by id order by seq desc) as rn from ({_DELTA})) where rn = 1"
_MERGED = f"select id, size as value from b where not is_dir and id not in (select id from ({_LAST})) union all select id, value from ({_LAST}) where not retract"
_LISTING = """, dirty as (select id as dir_id from e where depth = 3 and id % 3 = 0),
listing as (select parent as dir_id, name, id % 11 = 0 as is_dir, size + case when id % 5 = 0 then 1 else 0 end as size from e where depth = 4 and id % 7 <> 0 and parent in (select dir_id from dirty)
  union all select dir_id, 'new_' || cast(dir_id as varchar), false, 7 from dirty),
known as (select id, parent, name, is_dir, size from e where parent in (select dir_id from dirty)),
both_ as (select k.id, coalesce(k.parent, l.dir_id) as parent, coalesce(k.name, l.name) as name, k.is_dir as kd, l.is_dir, k.size as ks, l.size, k.id is not null as was, l.dir_id is not null as isnow
  from known k full join listing l on k.parent = l.dir_id and k.name = l.name)
"""
_GONE = "select 'remove' as action, id, parent, name from both_ where was and (not isnow or kd <> is_dir) union all select 'add', null, parent, name from both_ where isnow and (not was or kd <> is_dir)"
_EVENTS = """, ev as (select x.ts, case event_type when 'signup' then 'create' when 'error' then 'delete' when 'purchase' then 'moved' else 'attribute' end as kind,
  coalesce(d.path, '/elsewhere/' || cast(x.user_id as varchar)) as dir from events x left join e d on d.depth = 3 and d.id = 3000000000 + x.user_id),
touched as (select ts, dir from ev where kind in ('create', 'delete', 'moved') union all select ts, '/docs/en' from ev where kind = 'moved')
"""
OTHER_SQL = {
    "browse": f"select id, parent_path as path, attributes, case when is_dir then '18446744073709551615' else cast(size as varchar) end as size, {_KIND} from e where parent_path = '/data/ASIA' and is_dir order by fname, e.id limit 200",
    "limit_offset": "select id, size from e where ext = 'conf' order by size desc, id desc limit 50 offset 20",
    "topk": "select id, size from e where not is_dir order by size desc, id desc limit 100",
    "result_count": "select count(*) as total, count(*) filter (is_dir) as folders, count(*) filter (not is_dir) as files from e where ext = 'conf' or is_dir",
    "agg_result_counts": "select count(*) as total, count(*) filter (is_dir) as folders, count(*) filter (not is_dir) as files from e where ext in ('conf', 'log') or depth < 4",
    "filter_stage2": "select id, path from e where ext = 'conf' and contains(dname, '_1')",
    "date_periods": "select id, path from e where mtime between 1698796800 and 1698796800 + 31 * 86400 - 1 or mtime between 1701388800 and 1701388800 + 31 * 86400 - 1 or mtime between 1672531200 and 1672531200 + 366 * 86400 - 1",
    "match_options": "select id from e where regexp_matches(fname, '(^|[^a-z0-9\\x{80}-\\x{10FFFF}])order($|[^a-z0-9\\x{80}-\\x{10FFFF}])') or starts_with(fname, 'doc-1')",
    "columns_7": f"select id, {_COLUMNS}, {_KIND} from e where depth < 4",
    "col_path": "select id, parent_path as path from e", "col_full_path": "select id, path as file_list_filename from e", "col_attributes": "select id, attributes from e",
    "col_filetime": f"select id, {_FILETIME.format('mtime')} as date_modified, {_FILETIME.format('ctime')} as date_created, {_FILETIME.format('mtime')} as date_recently_changed from e",
    "col_size_sentinel": "select id, case when is_dir then '18446744073709551615' else cast(size as varchar) end as size from e",
    "wire_block": "select ' PATH ' || parent_path || chr(10) || ' SIZE ' || cast(size as varchar) || chr(10) || ' FILE ' || dname as line from e where ext = 'conf' and size > 200000",
    "cli_print": "select '- ' || lpad(cast(size as varchar), 12, ' ') || '  ' || strftime(to_timestamp(mtime) at time zone 'UTC', '%Y-%m-%d %H:%M') || '  ' || path as line from e where ext = 'log' and size > 200000",
    "list_dir": "select id, name, size from e where parent_path = '/docs/en' and parent is not null",
    "tombstone_filter": "select count(*) as n, cast(sum(size) as bigint) as bytes from e where not is_dir and id % 5 <> 0",
    "roots_list": "select id, name from e where parent is null order by id",
    "roots_validate": "select a.path, b.path as \"outer\" from given a join given b on a.k <> b.k and (rtrim(a.path, '/') = rtrim(b.path, '/') or starts_with(a.path, rtrim(b.path, '/') || '/'))",
    "index_finalize": "select id, path, parent_path, depth, nchild, ext, attributes, is_hidden from e",
    "join_path": "select id, path, depth from e", "join_children": "select d.id as dir_id, d.name as dir_name, b.id, b.name from b join b d on b.parent = d.id and d.is_dir",
    "agg_child_count": "select parent, count(*) as nchild from b where parent is not null group by parent",
    "agg_ext_cardinality": "select ext, count(*) as n from e where ext is not null group by ext",
    "agg_ext_histogram": "select cast(floor(log10(n)) as integer) as bucket, count(*) as extensions, cast(sum(n) as bigint) as files from (select ext, count(*) as n from e where ext is not null group by ext) group by 1",
    "agg_distinct_names": "select count(*) as n, count(distinct name) as names from b",
    "agg_type_split": "select is_dir, count(*) as n, cast(sum(size) as bigint) as bytes from e group by is_dir",
    "scan_stats": "select count(*) as n, count(*) filter (is_dir) as dirs, max(depth) as max_depth, cast(sum(size) as bigint) as bytes from e",
    "win_dense_rank": "select fname, row_number() over (order by fname) - 1 as rank from (select distinct fname from e)",
    "win_rank_gap": "select v.name, (select count(distinct fname) from e where fname < v.name) as below from (values ('asia'), ('doc-5'), ('order_2'), ('zzz'), ('')) v(name)",
    "trigram_index": "select trigram, count(*) as n from (select distinct id, substr(fname, i, 3) as trigram from (select id, fname, unnest(range(1, length(fname) - 1)) as i from e where length(fname) >= 3)) group by trigram",
    "set_union_roots": "select id, path from e where parent in (0, 1, 2)",
    "set_bitmap_ops": "select 'union' as op, id from e where ext = 'conf' or size > 200000 union all select 'intersect', id from e where ext = 'conf' and size > 200000 union all select 'except', id from e where ext = 'conf' and not size > 200000",
    "win_last_write": _LAST, "delta_merge": _MERGED, "delta_read": f"select id, value from ({_MERGED}) where value between 10000 and 20000",
    "join_sweep": "select id as dir_id from b where is_dir and id % 4 = 1",
    "closure_subtree": "select id from e where path = '/data/ASIA/NATION_2' or path like '/data/ASIA/NATION_2/%' or path = '/docs/de' or path like '/docs/de/%'",
    "compact": "select k.rn as id, u.rn as parent, k.name from (select *, row_number() over (order by id) - 1 as rn from b where is_dir or id % 3 <> 0) k left join (select id, row_number() over (order by id) - 1 as rn from b where is_dir or id % 3 <> 0) u on k.parent = u.id",
    "locations_reload": "select path as name, 'added' as change from e where parent = 0 union all select name, 'dropped' from b where parent is null and name <> '/docs'",
    "trigram_postings": "select distinct substr(fname, i, 3) as trigram, id from (select id, fname, unnest(range(1, length(fname) - 1)) as i from e where length(fname) >= 3 and depth < 4)",
    "text_trigram": "select id, path from e where contains(fname, 'der_12')", "index_skip": "select id, path from e where contains(fname, 'der_12')",
    "delta_due": f"select (select count(*) from ({_DELTA}) where id % 50 = 0) * 100 > (select count(*) from b where not is_dir) as wanted",
    "snapshot_load": "select id, parent, name, size, mtime from b where id % 7 <> 3 or is_dir", "roots_file": "select path as name from e where parent = 0",
    "resolve_path": "select id, step, case step when '..' then '/data' when '.' then path when 'x/../y' then path || '/y' when '/docs/./de' then '/docs/de' else '/data/AFRICA' end as path from e, (values ('..'), ('.'), ('x/../y'), ('..\\AFRICA//'), ('/docs/./de')) s(step) where parent = 0",
}


#: The tree of scan_tree, and what is left of it after update_tree.
_SCANNED = """select '' as path, 0 as depth, true as is_dir, cast(null as bigint) as size
  union all select '/' || r_name, 1, true, null from region union all select '/' || r_name || '/in', 2, true, null from region"""
_NATIONS = "union all select '/' || r_name || '/in/' || n_name, 3, false, {size} from nation join region on n_regionkey = r_regionkey"
_SORT_SQL = {"name": "fname", "path": "fpath, fname", "file_list_filename": "fpath, fname", "size": "size", "inverse_size": "size",
    "extension": "coalesce(ext, ''), fname", "attributes": "attributes", "date_modified": "mtime", "date_created": "ctime",
    "date_recently_changed": "mtime"}


def _sort_names_sql() -> str:
    one = []
    for key, columns in _SORT_SQL.items():
        for way, word in (("ascending", "asc"), ("descending", "desc")):
            order = ", ".join(f"{c} {word}" for c in [*columns.split(", "), "id"]) if "(" not in columns else f"coalesce(ext, '') {word}, fname {word}, id {word}"
            one.append(f"select '{key}_{way}' as sort, (select id from e where not is_dir and depth = 4 order by {order} limit 1) as id")
    return " union all ".join(one)


def oracle_sql() -> dict[str, str]:
    found = {k: f"{E} select id, path from e where {where}" for k, (_, where) in SEARCHES.items()}
    found |= {k: f"{E} select id, row_number() over (order by {order}) as pos from e where not is_dir or depth < 3" for k, (_, order) in SORTS.items()}
    found |= {k: f"{E} {sql}" for k, sql in OTHER_SQL.items()}
    found["join_reconcile"] = f"{E} {_LISTING} {_GONE} union all select 'touch', id, parent, name from both_ where was and isnow and kd = is_dir and ks <> size"
    found["reconcile_names"] = f"{E} {_LISTING} {_GONE}"
    found["apply_changes"] = f"""{E} {_LISTING} select parent, name, is_dir, size from e where id not in (select id from known) or id in (select parent from known)
      union all select parent, name, is_dir, size from both_ where isnow"""
    found["roots_validate"] = f"""{E}, given as (select path, row_number() over () as k from (select path from e where is_dir and depth < 2 and path <> '/data'
      union all select * from (values ('/data/'), ('/data'), ('/database')) t(path))) {OTHER_SQL['roots_validate']}"""
    found["reconcile_deep"] = f"{E} {_LISTING} select id, parent, name, size from both_ where was and isnow and kd = is_dir and ks <> size"
    found["epoch"] = f"{E} {_LISTING} select 7 + cast(count(*) > 0 as integer) as epoch from ({_GONE})"
    found["sort_names"] = f"{E} {_sort_names_sql()}"
    found["scan_tree"] = f"{_SCANNED} {_NATIONS.format(size='n_nationkey')}"
    found["update_tree"] = f"""{_SCANNED} {_NATIONS.format(size='case n_nationkey when 1 then 2 else n_nationkey end')} where n_nationkey % 2 <> 0
      union all select '/' || r_name || '/new', 2, true, null from region union all select '/' || r_name || '/new/below', 3, true, null from region"""
    found["ev_parent_dir"] = f"{E} {_EVENTS} select dir, count(*) as marks from touched group by dir"
    found[
        "ev_prefix"] = f"{E} {_EVENTS} select dir, count(*) as marks from touched where dir = '/data/ASIA' or dir like '/data/ASIA/%' or dir = '/do' or dir like '/do/%' group by dir"
    found["ev_dedup"] = f"{E} {_EVENTS} select distinct e.id as dir_id from touched t join e on e.path = t.dir and e.is_dir"
    found["ev_loss"] = f"{E} {_EVENTS} select count(*) as losses from ev where kind = 'delete'"
    found["ev_coalesce"] = f"""{E} {_EVENTS}, g as (select ts, dir, sum(fresh) over (order by ts, dir rows unbounded preceding) as burst from
      (select ts, dir, case when ts - lag(ts) over (order by ts, dir) < interval 10 minutes then 0 else 1 end as fresh from touched)),
      h as (select *, (row_number() over (partition by burst order by ts, dir) - 1) // {ev.BURST_MARKS} as part from g)
      select epoch_us(min(ts)) as begin_us, count(*) as marks, count(distinct dir) as dirs from h group by burst, part"""
    return found


