"""Small catalogs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.sources import catalog

MTIME = 1_600_000_000


def tree(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Base entries from (path, size or None for a directory); a path's parent comes before it."""
    ids = {path: k for k, (path, _) in enumerate(rows)}
    out = []
    for path, size in rows:
        above = path.rpartition("/")[0]
        parent = ids.get(above)
        out.append((ids[path], parent, path if parent is None else path.rpartition("/")[2], None, size is None, 4096 if size is None else size, MTIME, MTIME, MTIME * 10**9, False))
    return spark.createDataFrame(out, catalog.BASE)


FLAT = [
    ("/t/flat", None), ("/t/flat/sub1", None), ("/t/flat/sub2", None), ("/t/flat/empty", None), ("/t/flat/sub1/deep", None), ("/t/flat/a.txt", 0),
    ("/t/flat/b.conf", 500), ("/t/flat/c.conf", 5000),
    ("/t/flat/d.log", 0), ("/t/flat/.hidden", 0), ("/t/flat/sub1/x.conf", 200), ("/t/flat/sub2/y.txt", 100), ("/t/flat/sub1/deep/leaf.txt", 1),
]
