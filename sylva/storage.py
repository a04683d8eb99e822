"""Where intermediate tables go, and how they are released."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_pinned: list[DataFrame] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a folder of this
    machine on a local master (tests), else an error: executors would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault("at", tempfile.mkdtemp(prefix="sylva-") if "at" not in _own else "")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _written.append(at)
    return spark.read.schema(df.schema).parquet(at)


def pinned(df: DataFrame) -> DataFrame:
    """df computed once: written to the shared folder if the session names one, else cached. What depends on it is
    lazy, so it stays until release()."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return written(df, "pinned")
    _pinned.append(df.persist())
    return df


def release(spark: SparkSession) -> int:
    """Removes all that written() and pinned() hold and returns how many tables went; results that still read them fail."""
    gone = len(_written) + len(_pinned)
    while _pinned:
        _pinned.pop().unpersist()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
