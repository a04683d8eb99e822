"""Small documents with everything that operators must bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, bucket long, _hits string, _row string, _w string, _key string, findings string, size string, u string, kept string, host string"


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(doc_id, text, lang, source) with further columns whose names operators use for their own."""
    rows = edge_rows() if rows is None else rows
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, 2, "a", "r", "w", "k", "b", "c", "d", "e", "f") for i, t, lang, s in rows], SCHEMA).repartition(3)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    common = "the of and to in a is that for it".split()
    words = [r.choice(common) if r.random() < 0.4 else "".join(r.choices(["an", "er", "ti", "on", "sh", "re", "lo", "mi"], k=r.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def edge_rows() -> list[tuple]:
    a, b = prose(1, 120), prose(2, 90)
    return [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, a.replace("the", "thy", 1), "en", "s2"), (4, None, "en", "s1"), (5, "", None, "s1"),
        (6, " \t\n ", "en", None), (7, "one two", "en", "s2"), (8, "One TWO", "en", "s2"),
        (9, b, "en", None), (9, b, "en", None), (10, b + "\n" + a[:300], "fr", "s3"), (11, "x" * 5000, "en", "s3"),
        (12, "ü ß é 日本 🙂 " * 40, "de", "s3"), (13, prose(3, 4000), "en", "s1"), (14, "a\x00b \x85 c", "xx", "s2"),
        (None, prose(4, 60), None, "s1"), (None, None, None, None), (16, prose(5, 60), None, "s2"),
        (17, ("line of words here now\n" * 30), "en", "s2"), (18, prose(3, 4000)[1000:9000], "en", "s1"),
    ]
