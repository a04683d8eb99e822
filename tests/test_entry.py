"""The entry file without the corpus operators: it imports, and the catalog's queries run."""

import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).resolve().parents[1]
RUN = """
import __spark_entry__ as e
names = e.queries()
assert names and "pipeline" not in names and not any(n.startswith("op1_") for n in names), sorted(names)
assert e.oracle_sql().keys() <= names.keys()
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).columns
assert names["root"](spark, "/root/testdata/sf0.001").count() > 0
"""


@pytest.mark.parametrize("gone", [("sylva/llm", "tests/llm"), ("sylva/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_corpus_operators(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        at = tmp_path / "repo" / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    done = subprocess.run([sys.executable, "-B", "-c", RUN], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
