"""Helpers that the corpus operators share: tables, shared storage, ragged text in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import release, shared_dir, written

__all__ = ["release", "shared_dir", "written"]
WHITE = " \t\n\x0b\x0c\r"
TOP = "9223372036854775807"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_partitions(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, end to end, and its n + 1 offsets; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches, column: str, most: int = 4 << 20, rows: int = 1 << 30):
    """Cuts record batches into runs of at most so many rows and bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offs = text_bytes(batch.column(batch.schema.get_field_index(column)))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


_P = 0x9E3779B97F4A7C15 | 1
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Powers:
    """Powers of an odd number mod 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int = _P):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grown(self, have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        return have

    def both(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.up, self.down = self._grown(self.up, self.base, n), self._grown(self.down, self.inverse, n)
        return self.up, self.down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of the bytes of each span [start, end)."""
    up, down = powers.both(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, none across texts, and the text each is in."""
    mask = is_word[data]
    inner = np.zeros(len(data) + 1, bool)
    inner[1:-1] = mask[1:] & mask[:-1] if len(data) else False
    inner[offs] = False  # a text's first byte begins a word, its last one ends a word
    padded = np.append(mask, False)
    starts = np.flatnonzero(padded & ~inner)
    ends = np.flatnonzero(np.append(False, mask) & ~inner)
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def quoted(name: str) -> str:
    """A column's name so that dots, blanks and backticks in it are taken as they are."""
    return "`" + name.replace("`", "``") + "`"


def others(columns: list[str], made) -> list[str]:
    """The columns whose names are none of those made, in whatever case."""
    low = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in low]


def held(docs: DataFrame, columns: list[str]) -> Column:
    """A row's columns as one, named _row: they pass through an operator whatever they are called."""
    return F.struct(F.lit(0).alias("_"), *[docs[quoted(c)].alias(c) for c in columns]).alias("_row")


def beside(docs: DataFrame, column: str, made=()) -> tuple[DataFrame, list[str]]:
    """_row, with all columns but those made and `column`, beside `column`; and the names of all but those made."""
    names = others(docs.columns, made)
    return docs.select(held(docs, [c for c in names if c != column]), docs[column].alias(column)), names


def rejoined(names: list[str], column: str) -> list[Column]:
    """The columns that beside() set apart, in their order."""
    return [F.col(column) if c == column else released([c])[0] for c in names]


def extended(schema: T.StructType, **made) -> T.StructType:
    """schema with further columns: their names and types."""
    out = T.StructType(list(schema.fields))
    for name, kind in made.items():
        out = out.add(name, kind)
    return out


def released(columns: list[str], row: str = "_row") -> list[Column]:
    return [F.col(row)[c].alias(c) for c in columns]
