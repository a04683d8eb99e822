"""build, update and snapshots over a real directory, against a fresh scan of it."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from sylva import storage
from sylva.operators import incremental, update
from sylva.sources import catalog, files
from tests.fixtures import FLAT, tree


def put(path, text="", at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "root"
    for name in ("a.txt", "sub/b.txt", "sub/deep/c.txt", "sub/deep/deeper/d.txt", "other/e.txt"):
        put(r / name, name)
    return r


def rows(base, files_too=True):
    e = catalog.with_paths(catalog.live(base))
    kept = [F.when(F.col("is_dir") | F.lit(files_too), F.col(c)).alias(c) for c in ("size", "mtime", "stamp")]
    return sorted(map(tuple, e.select("path", "is_dir", *kept).collect()))


def names(base):
    return [r[:2] for r in rows(base)]


def test_sequence(spark, root, tmp_path):
    at = str(tmp_path / "db")
    base = update.build(spark, [str(root)], out=at)
    assert rows(base) == rows(files.scan(spark, [str(root)]))

    def step(deep=False, sweep=False, **how):
        nonlocal base
        done = update.update(base, deep=deep, sweep=sweep, **how)
        assert catalog.save(done.base, at) is True
        base = catalog.load(spark, at)
        return done

    fresh = lambda: files.scan(spark, [str(root)])
    nothing = step()
    assert not nothing.changed and nothing.counts == {"listed": 1, "failed": 0, "added": 0, "removed": 0, "touched": 0}
    put(root / "new.txt", "n")
    created = step()
    assert created.changed and created.counts["added"] == 1 and rows(base) == rows(fresh())
    (root / "a.txt").unlink()
    assert step().counts["removed"] == 1 and rows(base) == rows(fresh())
    (root / "new.txt").rename(root / "renamed.txt")
    done = step()
    assert (done.counts["added"], done.counts["removed"]) == (1, 1) and rows(base) == rows(fresh())
    (root / "renamed.txt").unlink()
    put(root / "renamed.txt" / "inside.txt")  # file to directory, and what is in it
    done = step()
    assert (done.counts["added"], done.counts["removed"]) == (2, 1) and rows(base) == rows(fresh())
    shutil.rmtree(root / "renamed.txt")
    put(root / "renamed.txt", "again")  # and back
    done = step()
    assert (done.counts["added"], done.counts["removed"]) == (1, 1) and rows(base) == rows(fresh())
    for k in range(3):
        put(root / "tree" / f"x{k}" / "y" / "z.txt")  # a new subtree is walked whole
    assert step().counts["added"] == 1 + 3 * 3 and rows(base) == rows(fresh())
    shutil.rmtree(root / "tree")
    assert step().counts["removed"] == 1 and rows(base) == rows(fresh())
    os.link(root / "renamed.txt", root / "hard.txt")
    assert step().counts["added"] == 1 and names(base) == names(fresh())
    step(deep=True)  # the link moved the other name's ctime
    put(root / "sub" / "b.txt", "much longer than before")
    assert not step().changed and rows(base) != rows(fresh())  # a names pass does not see contents
    done = step(deep=True)
    assert done.changed and done.counts["touched"] == 1 and rows(base) == rows(fresh())
    put(root / "sub" / "deep" / "late.txt")  # below a directory whose stamp does not move
    assert not step().changed and names(base) != names(fresh())
    assert step(sweep=True).counts["added"] == 1 and rows(base) == rows(fresh())
    (root / "sub" / "deep" / "deeper" / "d.txt").rename(root / "sub" / "deep" / "deeper" / "f.txt")
    assert not step().changed
    one = step(dirs=[str(root / "sub" / "deep" / "deeper")])
    assert (one.counts["added"], one.counts["removed"], one.counts["listed"]) == (1, 1, 1) and rows(base) == rows(fresh())
    for how in ({"roots": [str(tmp_path)]}, {"roots": [str(root / "sub")]}, {"dirs": [str(root / "nowhere")]}, {"dirs": [str(root / "renamed.txt")]},
        {"dirs": [str(root)], "roots": [str(root)]}):
        before = rows(base)
        with pytest.raises(ValueError, match="not|both"):
            update.update(base, **how)
        assert rows(base) == before
    last = step(roots=[str(root)])
    assert not last.changed
    again = catalog.load(spark, at)
    assert rows(again) == rows(base)
    assert storage.release(spark) > 0


def test_a_directory_that_cannot_be_read_keeps_its_rows(spark, root):
    base = update.build(spark, [str(root)]).persist()
    before = names(base)
    shutil.move(root, str(root) + "-away")
    done = update.update(base)
    assert done.counts == {"listed": 1, "failed": 1, "added": 0, "removed": 0, "touched": 0} and names(done.base) == before


def test_build_refuses(spark, root, tmp_path):
    (tmp_path / "roots").write_text(f"# roots\n{root}/sub\n")
    with pytest.raises(ValueError, match="lies in"):
        update.build(spark, [str(root)], str(tmp_path / "roots"))
    with pytest.raises(ValueError, match="no roots"):
        update.build(spark)
    with pytest.raises(ValueError, match="more than"):
        update.build(spark, [f"/x{k}" for k in range(65)])
    out = str(tmp_path / "db")
    base = update.build(spark, [], str(tmp_path / "roots"), out)
    assert {r.name for r in catalog.roots(base).collect()} == {str(root / "sub")}
    assert not update.reload(spark, out, [str(root / "sub")])
    assert update.reload(spark, out, [str(root)]) and {r.name for r in catalog.roots(catalog.load(spark, out)).collect()} == {str(root)}


def test_snapshot_versions(spark, tmp_path):
    at = str(tmp_path / "s")
    base = tree(spark, FLAT)
    assert catalog.saved_epoch(spark, at) is None and catalog.save(base, at, 7)
    assert not catalog.save(base.limit(1), at, 7) and catalog.load(spark, at).count() == 13
    loaded = catalog.load(spark, at)
    assert catalog.save(loaded.filter("not is_dir"), at, 8)  # over the snapshot it was loaded from
    assert catalog.load(spark, at).count() == 8 and loaded.count() == 13 and catalog.saved_epoch(spark, at) == 8
    with pytest.raises(Exception, match="broken"):
        catalog.save(loaded.withColumn("name", F.raise_error(F.lit("broken"))), at, 9)
    assert catalog.load(spark, at).count() == 8


def test_circles_and_depths(spark):
    rows = [(1, None, "/r", True), (2, 1, "a", True), (3, 2, "f", False), (10, 11, "x", True), (11, 10, "y", True), (12, 10, "in circle", False), (20, 99, "no parent", False)]
    base = catalog.entries(spark.createDataFrame(rows, "id long, parent long, name string, is_dir boolean"))
    assert {r.path for r in catalog.with_paths(base).collect()} == {"/r", "/r/a", "/r/a/f"}
    assert {r.id for r in catalog.unrooted(base).collect()} == {10, 11, 12, 20}
    assert {r.path for r in catalog.with_paths(base.filter("id < 10"), 1).collect()} == {"/r", "/r/a", "/r/a/f"}
    with pytest.raises(Exception, match="deeper than 0"):
        catalog.with_paths(base.filter("id < 10"), 0).collect()
    got = incremental.subtree(base, spark.createDataFrame([(10,)], "id long"))
    assert {r.id for r in got.collect()} == {10, 11, 12}


def test_a_large_subtree(spark):
    """Two million rows below one directory, over a chain of forty."""
    n = 2_000_000
    dirs = spark.range(41).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(True).alias("is_dir"))
    leaves = spark.range(100, 100 + n).select("id", (F.col("id") % 41).alias("parent"), F.lit(False).alias("is_dir"))
    base = catalog.entries(dirs.union(leaves).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string"))))
    gone = incremental.subtree(base, spark.createDataFrame([(1,)], "id long"))
    assert gone.count() == 40 + leaves.filter("parent >= 1").count()


def test_merge_policy(spark):
    main = spark.range(1000)
    due = lambda n, idle=0.0: incremental.wants_merge(main, spark.range(n), idle).first()[0]
    assert [due(10), due(11), due(0, 100.0), due(1, 59.0), due(1, 61.0)] == [False, True, False, False, True]
