"""Sources that read file trees: a Spark data source for directory scans, and the list of roots."""

from __future__ import annotations

import json
import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_DEPTH, MAX_ROOTS = 512, 64
SCHEMA = "path string, parent_path string, name string, depth int, is_dir boolean, size long, mtime long, ctime long, stamp long"


def _row(path: str, above: str | None, name: str, depth: int) -> tuple | None:
    """The entry at path; None if it is gone meanwhile."""
    try:
        s = os.lstat(path)
    except OSError:
        return None
    return path, above, name, depth, stat.S_ISDIR(s.st_mode), s.st_size, int(s.st_mtime), int(s.st_ctime), s.st_mtime_ns


def _entries(path: str) -> list:
    """A directory's entries; none if it is gone or closed to us meanwhile."""
    try:
        with os.scandir(path) as it:
            return list(it)
    except OSError:
        return []


class _Part(InputPartition):
    def __init__(self, root: str, top: str | None):
        self.root, self.top = root, top


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self):
        """The root itself with its files, and a partition for each directory right below it."""
        out = []
        for root in self.roots:
            out.append(_Part(root, None))
            with os.scandir(root) as it:
                out += [_Part(root, e.name) for e in sorted(it, key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, partition):
        return (r for r in self._rows(partition) if r is not None)

    def _rows(self, partition):
        root = partition.root
        if partition.top is None:
            yield _row(root, None, root, 0)
            for e in _entries(root):
                if not e.is_dir(follow_symlinks=False):
                    yield _row(e.path, root, e.name, 1)
            return
        top = os.path.join(root, partition.top)
        yield _row(top, root, partition.top, 1)
        todo = [(top, 1)]
        while todo:
            at, depth = todo.pop()
            if depth >= MAX_DEPTH:
                continue
            for e in _entries(at):
                yield _row(e.path, at, e.name, depth + 1)
                if e.is_dir(follow_symlinks=False):
                    todo.append((e.path, depth + 1))


class FileTree(DataSource):
    """spark.read.format('filetree').option('roots', '["a", "b"]').load(): the entries of file trees on shared storage."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader([os.path.abspath(r) for r in json.loads(self.options["roots"])])


def scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Base entries of file trees; ids follow the paths' order."""
    from ..operators import ordering
    from .catalog import entries

    spark.dataSource.register(FileTree)
    x = spark.read.format("filetree").option("roots", json.dumps(list(roots))).load()
    x = ordering.positions(x, [F.col("path")], name="id", first=0)
    up = x.select(F.col("path").alias("_path"), F.col("id").alias("parent"))
    return entries(x.join(up, x["parent_path"] == up["_path"], "left"))


def roots_file(spark: SparkSession, path: str) -> DataFrame:
    """name: the absolute paths of a text file, a line each; # begins a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\\s*#.*$", "")).alias("name")).filter("name <> ''")
    return lines.withColumn("name", F.when(F.startswith("name", F.lit("/")), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not an absolute path: "), F.col("name")))))


LISTED = "dir_id long, name string, is_dir boolean, size long, mtime long, ctime long, stamp long"


def listing(dirs: DataFrame) -> DataFrame:
    """What stands in directories (dir_id, path) on shared storage: a row per entry, and one without a name for each
    directory itself, whose is_dir is null if it could not be read. The directories are listed by the executors."""

    def each(batches):
        for batch in batches:
            rows = []
            for dir_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    own = os.stat(path)
                    with os.scandir(path) as it:
                        found = list(it)
                except OSError:
                    rows.append((dir_id, None, None, None, None, None, None))
                    continue
                rows.append((dir_id, None, True, own.st_size, int(own.st_mtime), int(own.st_ctime), own.st_mtime_ns))
                for e in found:
                    if (r := _row(e.path, path, e.name, 0)) is not None:
                        rows.append((dir_id, e.name, *r[4:]))
            kinds = [pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["dir_id", "name", "is_dir", "size", "mtime", "ctime", "stamp"])

    return dirs.select("dir_id", "path").mapInArrow(each, LISTED)


def stamps(dirs: DataFrame) -> DataFrame:
    """id, stamp: the present stamps of directories (id, path) that can be read."""

    def each(batches):
        for batch in batches:
            rows = [(i, r[8]) for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (r := _row(p, None, p, 0)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["id", "stamp"])

    return dirs.select("id", "path").mapInArrow(each, "id long, stamp long")
