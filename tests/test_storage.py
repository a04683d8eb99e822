"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from sylva import storage


def session(master, setting=None, conf=None):
    context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": conf} if conf else {})
    return SimpleNamespace(conf={"spark.checkpoint.dir": setting} if setting else {}, sparkContext=context)


def test_shared_folder():
    assert storage.shared_dir(session("spark://host:7077", "hdfs:///cp/")) == "hdfs:///cp"
    assert storage.shared_dir(session("yarn", conf="s3a://b/cp")) == "s3a://b/cp"
    assert storage.shared_dir(session("local[2]")) == storage.shared_dir(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))


def test_written_tables_are_released(spark):
    df = storage.written(spark.range(5), "five")
    pinned = storage.pinned(spark.range(3))
    assert df.count() == 5 and pinned.count() == 3
    assert storage.release(spark) >= 1 and storage.release(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|not found|FILE_NOT_EXIST"):
        df.count()
