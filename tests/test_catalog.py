"""The catalog's derivations, sources, incremental passes and streams on small trees."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sylva import storage
from sylva.operators import aggregates, incremental, ordering
from sylva.operators.search import search
from sylva.plans.compiler import matches
from sylva.sources import catalog, files
from sylva.streaming import events as ev
from tests.fixtures import FLAT, MTIME, tree


def chain(n: int) -> list[tuple]:
    rows, at = [("/r", None)], "/r"
    for _ in range(n):
        at += "/d"
        rows.append((at, None))
        rows.append((at + "/leaf.txt", 1))
    return rows


def test_deep_paths_in_few_joins(spark):
    e = catalog.enriched(tree(spark, chain(120)))
    assert e.filter("dname = 'leaf.txt'").agg(F.max("depth"), F.max(F.length("path"))).first() == (121, 2 + 120 * 2 + 9)
    known = catalog.enriched(tree(spark, chain(20)), depth=20)
    assert known.agg(F.max("depth")).first()[0] == 21


def test_orphans_and_tombstones_do_not_show(spark):
    base = tree(spark, FLAT)
    dead = base.withColumn("deleted", F.col("name") == "sub1")
    assert {r.dname for r in catalog.enriched(dead).collect()} == {"flat", "sub2", "empty", "a.txt", "b.conf", "c.conf", "d.log", ".hidden", "y.txt"}


@pytest.mark.parametrize(("name", "ext", "stem"), [("a.txt", "txt", "a"), ("a.TXT", "txt", "a"), (".hidden", None, ".hidden"), ("a.", None, "a"),
    ("a.b.C", "c", "a.b"), ("plain", None, "plain"), (".a.b", "b", ".a")])
def test_names(spark, name, ext, stem):
    r = spark.createDataFrame([(name,)], "n string").select(catalog.extension(F.col("n")), catalog.stem(F.col("n"))).first()
    assert tuple(r) == (ext, stem)


def test_total_orders(spark):
    names = ["a_dir", "b.txt", "Apple.txt", "banana.txt", "Cherry.txt", "Ünicode.txt", "_z", "B.txt"] + [f"f{k}" for k in range(300)]
    e = catalog.enriched(tree(spark, [("/s", None)] + [(f"/s/{n}", 1) for n in names])).cache()
    got = [r.dname for r in search(e, "file:", sort="name_ascending").page().collect()]
    fold = lambda n: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in n).encode()
    assert got == [n for _, _, n in sorted((fold(n), k, n) for k, n in enumerate(names))]
    for key in ordering.SORT_KEYS:
        up = [r.id for r in search(e, "", sort=f"{key}_ascending").page().collect()]
        assert up == [r.id for r in search(e, "", sort=f"{key}_descending").page().collect()][::-1]
        assert up == [r.id for r in search(e, "", sort=f"{key}_ascending").positions().orderBy("pos").collect()]
    ranks = {r.fname: r.rank for r in aggregates.name_ranks(e).collect()}
    assert sorted(ranks.values()) == list(range(len(ranks))) and sorted(ranks, key=lambda n: n.encode()) == sorted(ranks, key=ranks.get)


def test_many_extensions(spark):
    e = catalog.enriched(tree(spark, [("/x", None)] + [(f"/x/f{k}.e{k:029d}", 1) for k in range(2200)])).cache()
    assert matches(e, "ext:e" + "0" * 28 + "7").count() == 1
    assert matches(e, "ext:" + ";".join(f"e{k:029d}" for k in range(400))).count() == 400


def listing(spark, rows):
    return spark.createDataFrame([(d, n, is_dir, size, m, m, m * 10**9) for d, n, is_dir, size, m in rows],
        "dir_id long, name string, is_dir boolean, size long, mtime long, ctime long, stamp long")


def test_reconcile(spark):
    base = tree(spark, FLAT)
    ids = {r.name: r.id for r in base.collect()}
    root, sub2, deep = ids["/t/flat"], ids["sub2"], ids["deep"]
    dirty = spark.createDataFrame([(root,), (sub2,)], "dir_id long")
    here = [(root, n, d, s, MTIME) for n, d, s in [("sub1", True, 4096), ("sub2", True, 4096), ("empty", False, 5), ("a.txt", False, 9), ("b.conf",
        False, 500), ("new.md", False, 3)]]
    seen = listing(spark, here)
    names = incremental.reconcile(base, seen, dirty)
    actions = sorted((r.action, r.name) for r in names.collect())
    assert actions == [("add", "empty"), ("add", "new.md"), ("remove", ".hidden"), ("remove", "c.conf"), ("remove", "d.log"), ("remove", "empty"), ("remove", "y.txt")]
    deepened = incremental.reconcile(base, seen, dirty, deep=True)
    assert sorted((r.action, r.name) for r in deepened.collect()) == sorted([*actions, ("touch", "a.txt")])
    after = incremental.apply_changes(base, deepened).cache()
    again = incremental.reconcile(after, seen, dirty, deep=True)
    assert again.count() == 0 and incremental.epoch_after(3, again).first()[0] == 3 and incremental.epoch_after(3, deepened).first()[0] == 4
    live = {r.path: (r.is_dir, r.size) for r in catalog.enriched(after).collect()}
    assert live["/t/flat/empty"] == (False, 5) and live["/t/flat/a.txt"] == (False, 9) and "/t/flat/sub2/y.txt" not in live and live["/t/flat/sub1/deep/leaf.txt"] == (False, 1)
    small = incremental.compacted(after)
    assert sorted(r.id for r in small.collect()) == list(range(len(live)))
    assert {r.path for r in catalog.enriched(small).collect()} == set(live)
    gone = incremental.apply_changes(base, incremental.reconcile(base, listing(spark, []), spark.createDataFrame([(ids["sub1"],)], "dir_id long")))
    assert {r.id for r in gone.filter("deleted").collect()} == {ids["x.conf"], deep, ids["leaf.txt"]}
    assert [r.dir_id for r in incremental.sweep(base, base.select("id", (F.col("stamp") + (F.col("id") == deep).cast("int")).alias("stamp"))).collect()] == [deep]
    assert not incremental.wants_compaction(after).first()[0] and incremental.wants_compaction(after, least=5).first()[0]


def test_delta(spark):
    main = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, value long")
    delta = spark.createDataFrame([(1, 2, 21, False), (2, 2, 22, False), (3, 3, 0, True), (4, 4, 40, False), (5, 5, 50, False), (6, 5, 0, True)],
        "seq long, id long, value long, retract boolean")
    assert sorted(map(tuple, incremental.merged(main, delta).collect())) == [(1, 10), (2, 22), (4, 40)]


def test_snapshot(spark, tmp_path):
    base = tree(spark, FLAT)
    catalog.save(base, str(tmp_path / "s"))
    assert catalog.load(spark, str(tmp_path / "s")).count() == 13
    base.drop("stamp").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        catalog.load(spark, str(tmp_path / "t"))


def test_file_tree(spark, tmp_path):
    (tmp_path / "r/a/b").mkdir(parents=True)
    (tmp_path / "r/a/b/x.txt").write_text("hello")
    (tmp_path / "r/y.txt").write_text("")
    os.symlink(tmp_path / "r/a", tmp_path / "r/link")
    e = catalog.enriched(files.scan(spark, [str(tmp_path / "r")]))
    want = {str(tmp_path / "r")} | {os.path.join(d, n) for d, ds, fs in os.walk(tmp_path / "r") for n in ds + fs}
    rows = {r.path: r for r in e.collect()}
    assert set(rows) == want and rows[str(tmp_path / "r/a/b/x.txt")].size == 5 and not rows[str(tmp_path / "r/link")].is_dir
    (tmp_path / "roots").write_text("# here\n/data\n\n  /docs \n")
    assert [r.name for r in files.roots_file(spark, str(tmp_path / "roots")).collect()] == ["/data", "/docs"]
    (tmp_path / "bad").write_text("data\n")
    with pytest.raises(Exception, match="not an absolute path"):
        files.roots_file(spark, str(tmp_path / "bad")).collect()


def test_overlapping_roots_do_not_hang_on_row_order(spark):
    """The table gives its rows in another order each time it is read."""

    def shuffled(batches):
        for b in batches:
            yield b.sample(frac=1)

    rows = [f"/r{k}" for k in range(40)] + ["/", "/r1/x/y", "/r2/", "/r3/\n", "/r40", "/r40", "/r40", None]
    paths = spark.createDataFrame([(p,) for p in rows], "path string").coalesce(1).mapInPandas(shuffled, "path string")
    got = sorted((r.path, r.outer) for r in catalog.overlapping_roots(paths).collect())
    want = [("/r1/x/y", "/r1"), ("/r2", "/r2/"), ("/r2/", "/r2"), ("/r3/\n", "/r3"), *[("/r40", "/r40")] * 6]
    assert got == sorted([*want, *[(p, "/") for p in rows if p and p != "/"]])


EVENTS = [
    ("2024-01-01 00:00:00.000", "create", "/t/flat/new", None), ("2024-01-01 00:00:00.020", "moved", "/t/flat/sub1/x", "/t/flat/sub2/x"),
    ("2024-01-01 00:00:00.030", "attribute", "/t/flat/a.txt", None),
    ("2024-01-01 00:00:01.000", "delete", "/t/flatter/q", None), ("2024-01-01 00:00:01.010", "delete", "/t/flat/sub1/z", None),
    ("2024-01-01 00:00:01.020", "create", "/t/flat/nowhere/z", None),
]


def events(spark, rows=EVENTS):
    return spark.createDataFrame(rows, "t string, kind string, path string, old_path string").select(F.col("t").cast("timestamp").alias("ts"), "kind", "path", "old_path")


def test_events(spark):
    e = catalog.enriched(tree(spark, FLAT))
    dirs = e.filter("is_dir").select("id", "path")
    names = {r.id: r.dname for r in e.collect()}
    dirty = [names[r.dir_id] for r in ev.dirty_directories(events(spark), dirs, ["/t/flat"]).collect()]
    assert sorted(dirty) == ["flat", "sub1", "sub2"]
    assert ev.under_roots(ev.touched_paths(events(spark)), ["/t/flat"]).count() == 5
    assert [(r.marks, r.dirs) for r in ev.coalesced(events(spark)).orderBy("begin").collect()] == [(3, 3), (3, 3)]
    assert [(r.marks, r.dirs) for r in ev.coalesced(events(spark), most=2).orderBy("begin", "marks").collect()] == [(2, 2), (1, 1), (2, 2), (1, 1)]
    assert ev.lost(events(spark)).first()[0] == 0
    assert ev.lost(events(spark, [*EVENTS, ("2024-01-01", "overflow", None, None)])).first()[0] == 1


def bursts(rows, gap, most):
    """By hand, over (seconds or None, dir) in order."""
    out, last = [], None
    for t, d in sorted(rows, key=lambda r: (r[0] is not None, r)):
        if last is None or t is None or t - last >= gap:
            out.append([])
        elif len(out[-1]) == most:
            out.append([])
        out[-1].append((t, d))
        last = t
    return sorted((str(b[0][0]), len(b), len({d for _, d in b})) for b in out)


@pytest.mark.parametrize("gap", [3, 0])
@pytest.mark.parametrize("most", [1, 7, 5000])
def test_bursts_over_many_ranges(spark, monkeypatch, gap, most):
    """Bursts that run over several ranges, times of many directories, many marks of one time and directory, no times."""
    monkeypatch.setattr(ev, "RANGE_ROWS", 40)
    rng = random.Random(5)
    rows = [(t, f"/d{rng.randrange(9)}") for t in (rng.randrange(4000) for _ in range(900))] + [(t, "/d1") for t in range(5000, 5600)]
    rows += [(5100, f"/e{k}") for k in range(50)] + [(6000, "/f")] * 1500 + [(6002, "/d2"), (None, "/n"), (None, "/n"), (None, "/m")]
    e = spark.createDataFrame(rows, "t long, d string").select(F.timestamp_seconds("t").alias("ts"), F.lit("create").alias("kind"), F.concat("d", F.lit("/x")).alias("path"),
        F.lit(None).cast("string").alias("old_path"))
    got = ev.coalesced(e, f"{gap} seconds", most).select(F.unix_seconds("begin").alias("t"), "marks", "dirs").collect()
    assert sorted((str(r.t), r.marks, r.dirs) for r in got) == bursts(rows, gap, most)
    assert ev.coalesced(e.limit(0)).count() == 0


def test_bursts_are_not_ordered_in_one_task(spark):
    """Whatever the number of marks, a range holds about RANGE_ROWS: the largest one's rows are seen in what was pinned."""
    n = 3 * ev.RANGE_ROWS
    e = spark.range(n).select(F.timestamp_seconds("id").alias("ts"), F.lit("create").alias("kind"), F.lit("/d/x").alias("path"), F.lit(None).cast("string").alias("old_path"))
    assert ev.coalesced(e, "2 seconds").agg(F.sum("marks")).first()[0] == n
    dealt = storage._pinned[-1] if storage._pinned else spark.read.parquet(storage._written[-1])
    sizes = [r.n for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) < 0.6 * n


def test_stream(spark, tmp_path):
    dirs = catalog.enriched(tree(spark, FLAT)).filter("is_dir").select("id", "path").cache()
    src = str(tmp_path / "in")
    events(spark, EVENTS[:3]).coalesce(1).write.parquet(src)
    got, full = [], []
    stream = spark.readStream.schema(ev.SCHEMA).parquet(src)

    def run():
        q = ev.follow(stream, lambda: dirs, ["/t/flat"], lambda df, n: got.append(sorted(r.dir_id for r in df.collect())), full.append)
        q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert len(got) == 1 and len(got[0]) == 3 and not full
    events(spark, [("2024-01-01", "overflow", None, None)]).coalesce(1).write.mode("append").parquet(src)
    run()
    assert len(got) == 1 and len(full) == 1


def test_filters_reach_the_scan(spark, tmp_path):
    """Over a stored catalog the comparisons are pushed to Parquet and only the needed columns are read."""
    at = str(tmp_path / "e")
    catalog.materialise(catalog.enriched(tree(spark, FLAT)), at)
    e = spark.read.parquet(at)
    df = matches(e, "parent:/t/flat ext:conf size:>1k conf").select("id")
    pushed = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert all(x in pushed for x in ("EqualTo(parent_path,/t/flat)", "EqualTo(ext,conf)", "GreaterThanOrEqual(size,1025)", "IsNotNull(parent)"))
    assert "mtime" not in pushed and df.count() == 1
    assert matches(e, "!ext:conf").count() == 10 and matches(e, "!<ext:conf | size:0>").count() == 7
