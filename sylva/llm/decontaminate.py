"""Benchmark decontamination with a broadcast set of test n-grams.

A window is `width` consecutive words of an item, or the whole of a shorter item. All windows' hashes go to
the executors in a table of arrays whose size is bounded by the block of items it is built from (TABLE_BYTES, counted
from the items' words and bytes); texts are scanned as byte arrays, hash hits are verified on the words themselves.
A benchmark larger than a block is scanned block after block, the hits so far carried in two columns, so that no
broadcast grows with it.

Null, empty and wordless texts: no words, no hits. Null items have no words. Items of a null item_id: their windows
are hit, no id is listed or counted for them. Repeated items count apart, by item_id. Repeated documents get equal
rows. Empty tables: all rows clean, or no rows. Other columns stay; columns named like the results are replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH = 8
MIN_ITEMS = 2
#: Bytes of a broadcast table of windows, and what each word of an item takes in it at most.
TABLE_BYTES, WORD_BYTES = 96 << 20, 48

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_POWERS = common.Powers()
_BITS = 22


def _split(texts: pa.Array):
    data, offs = common.text_bytes(texts)
    data = common.LOWER[data]
    starts, ends, of = common.words_of(data, offs, WORD)
    return data, starts, ends, of, common.span_hashes(data, starts, ends, _POWERS), len(offs) - 1


def _window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return common.mixed(total)


class Windows:
    """The windows of a block of items: by width, their sorted hashes with the word each begins at, and a bitmap before them."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.ids = [i for i, _ in items]
        data, self.starts, self.ends, self.of, hashes, n = _split(pa.array([t for _, t in items], pa.string()))
        self.low = data.tobytes()
        counts = np.bincount(self.of, minlength=n) if n else np.zeros(0, np.int64)
        first = np.cumsum(counts) - counts
        self.tables, self.known = {}, {}
        for size in range(1, width + 1):
            inside = (counts >= width) if size == width else (counts == size)
            ws = _window_hashes(hashes, size)
            at = np.flatnonzero(inside[self.of[: len(ws)]] & (self.of[: len(ws)] == self.of[size - 1 :])) if len(ws) else np.zeros(0, np.int64)
            at = at[at + size <= (first + counts)[self.of[at]]]
            if not len(at):
                continue
            order = np.argsort(ws[at], kind="stable")
            table = ws[at][order]
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(table >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables[size] = (table, at[order], bitmap)

    def items(self, width: int, place: int) -> dict[bytes, set[int]]:
        """The items of each window whose hash is that at a place of the table, by the window's words."""
        got = self.known.get((width, place))
        if got is None:
            table, at, _ = self.tables[width]
            got = defaultdict(set)
            for i in at[place : int(np.searchsorted(table, table[place], "right"))].tolist():
                got[_joined(self.low, self.starts, self.ends, i, width)].add(int(self.of[i]))
            self.known[width, place] = got
        return got

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]], np.ndarray]:
        """Words of each text, hit flag of each word, item numbers by text, word offsets of the texts."""
        data, starts, ends, of, hashes, n = _split(texts)
        hit = np.zeros(len(starts), bool)
        found: dict[int, set[int]] = defaultdict(set)
        low = None
        for width, (table, _, bitmap) in self.tables.items():
            ws = _window_hashes(hashes, width)
            maybe = np.flatnonzero(bitmap[(ws >> np.uint64(64 - _BITS)).astype(np.int64)])
            maybe = maybe[of[maybe] == of[maybe + width - 1]] if len(maybe) else maybe
            place = np.minimum(np.searchsorted(table, ws[maybe]), len(table) - 1)
            alike = table[place] == ws[maybe]
            if alike.any() and low is None:
                low = data.tobytes()
            for i, k in zip(maybe[alike].tolist(), place[alike].tolist(), strict=True):
                got = self.items(width, k).get(_joined(low, starts, ends, i, width))
                if got:
                    hit[i : i + width] = True
                    found[int(of[i])] |= got
        counts = np.bincount(of, minlength=n) if len(of) else np.zeros(n, np.int64)
        return counts, hit, found, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _joined(low: bytes, starts: np.ndarray, ends: np.ndarray, i: int, width: int) -> bytes:
    return b" ".join(low[a:b] for a, b in zip(starts[i : i + width].tolist(), ends[i : i + width].tolist(), strict=True))


def _blocks(bench: DataFrame, table_bytes: int):
    """Items in lists whose tables take at most so many bytes (one item at least)."""
    block, size = [], 0
    text = F.coalesce("text", F.lit(""))
    need = F.octet_length(text) + WORD_BYTES * (F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) + 1)
    for item, text, own in bench.select(F.col("item_id").cast("string"), "text", need).toLocalIterator():
        if block and size + own > table_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += own
    yield block


MADE = {"_n_words": "long", "_n_hit": "long", "_hits": "binary", "_items": T.ArrayType(T.StringType())}


def _scanned(docs: DataFrame, bench: DataFrame, width: int, table_bytes: int) -> DataFrame:
    """docs, of columns _row and text, with those of MADE."""
    for k, block in enumerate(_blocks(bench, table_bytes)):
        if k > 1:
            docs = common.written(docs, "decontaminate")
        docs = _scan_block(docs, Windows(block, width))
    return docs


def scan(docs: DataFrame, bench: DataFrame, width: int = WIDTH, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs with _n_words, _n_hit, _hits (a bit for each word, most significant first) and _items (sorted ids)."""
    x, names = common.beside(docs, "text", MADE)
    return _scanned(x, bench, width, table_bytes).select(*common.rejoined(names, "text"), *MADE)


def _scan_block(docs: DataFrame, windows: Windows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def each(batches):
        w = shared.value
        for batch in common.slices(batches, "text", 1 << 20):
            counts, hit, found, at = w.find(batch.column(1))
            again = "_hits" in batch.schema.names
            old_hits = batch.column(4).to_pylist() if again else [None] * len(counts)
            old_items = batch.column(5).to_pylist() if again else [None] * len(counts)
            hits, items = [], []
            for i in range(len(counts)):
                bits = None
                if i in found:
                    bits = np.packbits(hit[at[i] : at[i + 1]])
                    if old_hits[i] is not None:
                        bits = bits | np.frombuffer(old_hits[i], np.uint8)
                hits.append(bits.tobytes() if bits is not None else old_hits[i])
                items.append(sorted({*(old_items[i] or []), *(w.ids[j] for j in found.get(i, ()) if w.ids[j] is not None)}))
            n_hit = [int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) if b else 0 for b in hits]
            made = [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["_row", "text", *MADE])

    return docs.mapInArrow(each, common.extended(docs.select("_row", "text").schema, **MADE))


def digest(scanned: DataFrame, columns: list[str], min_items: int = MIN_ITEMS) -> DataFrame:
    """columns with n_words, n_hit, n_items, items_sha256 and contaminated."""
    ids = F.col("_items")
    return scanned.select(*columns, F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.size(ids) >= min_items).alias("contaminated"))


def remove_documents(docs: DataFrame, bench: DataFrame, width: int = WIDTH, min_items: int = 1) -> DataFrame:
    """docs without those in which windows of at least min_items items occur and at least width words are hit:
    a short item alone, a word or two that any text may hold, does not condemn one."""
    leaked = F.col("_n_hit") >= width
    if min_items > 1:
        leaked = leaked & (F.size("_items") >= min_items)
    x, names = common.beside(docs, "text")
    return _scanned(x, bench, width, TABLE_BYTES).filter(~leaked).select(*common.rejoined(names, "text"))


def remove_spans(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, each text without its hit words; what stood between two hit words goes too."""
    x, names = common.beside(docs, "text")
    scanned = _scanned(x, bench, width, TABLE_BYTES).select("text", "_row", "_hits")

    def each(batches):
        for batch in common.slices(batches, "text", 1 << 20):
            texts = batch.column(0)
            data, offs = common.text_bytes(texts)
            starts, ends, of = common.words_of(common.LOWER[data], offs, WORD)
            at = np.searchsorted(of, np.arange(len(offs)))
            cleaned = []
            for i, bits in enumerate(batch.column(2).to_pylist()):
                if bits is None:
                    cleaned.append(texts[i].as_py())
                    continue
                n = at[i + 1] - at[i]
                hit = np.diff(np.concatenate([[0], np.unpackbits(np.frombuffer(bits, np.uint8), count=n), [0]]).astype(np.int8))
                keep, last = [], offs[i]
                for a, b in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1) - 1, strict=True):
                    keep.append(data[last : starts[at[i] + a]])
                    last = ends[at[i] + b]
                keep.append(data[last : offs[i + 1]])
                cleaned.append(b"".join(k.tobytes() for k in keep).decode())
            yield pa.RecordBatch.from_arrays([pa.array(cleaned, texts.type), batch.column(1)], names=["text", "_row"])

    return scanned.mapInArrow(each, scanned.drop("_hits").schema).select(*common.rejoined(names, "text"))
