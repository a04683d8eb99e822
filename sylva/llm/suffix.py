"""Substring deduplication with an enhanced suffix array and its common-prefix intervals.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus (a smaller doc_id,
or the same document and an earlier start).

1. Texts are packed by document bucket, compressed; that one exchange serves all steps below.
2. Every window of `length` bytes is dealt by its anchor, the smallest hash among the `gram`-byte strings in
   it, which depends on the window's bytes alone: equal windows meet, whatever stands around them. First the
   anchors' hashes meet, and a bit for each goes back: whether it occurs more than once.
3. Windows that share an anchor overlap, so for each anchor occurrence that is not unique one context of less
   than 2 * length bytes is sent. Within a bucket equal contexts are sent once; the later ones are repeats.
4. Where contexts meet, equal ones of an anchor are settled at once. For the different ones a suffix array with
   LCPs is built (prefix doubling on ranks). A stack scan over it gives the intervals of a common prefix of at
   least `length`; those whose occurrences differ in the byte to their left are the maximal repeats, each
   with all its occurrences. All but the first of them are repeats.
5. The repeats' spans go back to the documents' own buckets as compressed blocks.

An anchor of HOT occurrences or more is hot: mostly a string shorter than a window that many documents share, with
other text around it in each. Its contexts are cut where the smallest hashes near the window's two ends change, and are
dealt by these as well. That too depends on the window's bytes alone, and no place gets all surroundings of a
frequent string. A frequent passage of `length` bytes or more costs one context per document bucket. doc_id is a key:
repeated rows are equal and are one document. Null text: no bytes. Null doc_id: nothing is removed, and it is
no earlier occurrence. Texts under `length` bytes lose nothing. Empty table: empty result. Spans may cut a
character: kept bytes are bytes, not text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 24
#: Texts are scanned in pieces of so many bytes, which overlap by length - 1.
PIECE = 256 << 10
#: Bytes of text that a task packs before it sends them on.
PACK = 24 << 20
#: Bytes of text for which there is a bucket, about: a task holds one bucket at a time.
BUCKET_BYTES = 48 << 20
#: Occurrences from which on an anchor is hot, and how far from a window's ends its contexts are told apart.
HOT = 256
ZONE = 24
#: Bytes of context for which one suffix array is built, about.
ARRAY = 1 << 20
_POS = np.uint64((1 << 26) - 1)
_POWERS = common.Powers()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the spans, end to end."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.both(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(common.BYTE[data] * up[: len(data)], out=total[1:])
    return total


def window_hashes(total: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    return common.mixed((total[at + length] - total[at]) * _POWERS.both(len(total))[1][at])


def contexts(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor hash, text number, start and length of each context in texts laid end to end, and the anchor's place in it."""
    n, width = len(data), length - gram + 1
    if n < length:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e, e
    total = prefix_sums(data)
    grams = window_hashes(total, np.arange(n - gram + 1), gram)
    best = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    anchor = (best & _POS).astype(np.int64)  # by window
    lens = np.diff(offs)
    ok = np.zeros(len(anchor) + 1, bool)
    live = np.flatnonzero(lens >= length)
    ok[ragged(offs[live], lens[live] - length + 1)] = True
    ok = ok[: len(anchor)]
    edge = np.append(True, anchor[1:] != anchor[:-1])
    edge[offs[live]] = True
    begin = np.flatnonzero(ok & edge)
    stop = np.flatnonzero(ok & np.append(edge[1:] | ~ok[1:], True))
    at = anchor[begin]
    return grams[at], np.searchsorted(offs, begin, "right") - 1, begin, stop - begin + length, at - begin


def _chunks(lengths: np.ndarray, most: int):
    """Ranges (i, j) of spans of at most so many bytes together, one span at least."""
    sizes, i = np.cumsum(lengths), 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of spans end to end, without an index of every byte."""
    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([view[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]), np.uint8)


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans at a and b hold equal bytes."""
    out = np.zeros(len(a), bool)
    for i, j in _chunks(lengths, PIECE):
        n = lengths[i:j]
        equal = data[ragged(a[i:j], n)] == data[ragged(b[i:j], n)]
        out[i:j] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def span_digests(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans in the order of their starts, up to 256 bytes long."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + PIECE)))
        lo, end = start[i], start[j - 1] + 256
        total = prefix_sums(data[lo:end])
        a, n = start[i:j] - lo, lengths[i:j]
        out[i:j] = common.mixed((total[a + n] - total[a]) * _POWERS.both(len(total))[1][a] + n.astype(np.uint64))
        i = j
    return out


def first_of_equal(data, anchor, place, start, lengths, doc, offset):
    """For each context the number of the first one (by doc, offset) with the same anchor, place and bytes."""
    body = common.mixed(span_digests(data, start, lengths) + place.astype(np.uint64)) ^ anchor
    order = np.lexsort((offset, doc, body))
    b = body[order]
    new = np.append(True, b[1:] != b[:-1]) if len(b) else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))] if len(b) else order
    first = np.empty(len(b), np.int64)
    first[order] = head
    later = np.flatnonzero(first != np.arange(len(b)))
    alike = (lengths[later] == lengths[first[later]]) & (place[later] == place[first[later]]) & (anchor[later] == anchor[first[later]])
    alike[alike] = _same(data, start[later[alike]], start[first[later[alike]]], lengths[later[alike]])
    first[later[~alike]] = later[~alike]
    return first


def suffix_array(text: np.ndarray, ends: np.ndarray, at: np.ndarray, depth: int = 256):
    """at sorted by what follows in the text up to ends (the end of each place's context), and the LCPs.

    Ranks of 8 bytes come from the bytes themselves and are doubled up to `depth` bytes.
    """
    n = len(text)
    left = ends - np.arange(n)  # bytes from each place to its context's end
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | np.where(left > j, padded[j : n + j], 0).astype(np.uint64)
    step, ranks = 8, []
    # bytes are ranked with the number of bytes left, so that a context's end is not taken for zero bytes
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) * 9 + np.minimum(left, 8)
    while True:
        ranks.append((step, rank))
        if step >= depth:
            break
        ahead = np.full(n, -1, np.int64)
        full = np.flatnonzero(left > step)
        ahead[full] = rank[full + step]
        pair = rank * np.int64(9 * n + 9) + ahead + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = at[np.argsort(rank[at], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    end_a, end_b = ends[a], ends[b]
    lcp = np.zeros(len(a), np.int64)
    for step, rank in reversed(ranks[:-1]):
        go = np.flatnonzero(np.minimum(end_a - a, end_b - b) >= step)
        go = go[rank[a[go]] == rank[b[go]]]
        a[go] += step
        b[go] += step
        lcp[go] += step
    for _ in range(7):
        go = np.flatnonzero(np.minimum(end_a - a, end_b - b) > 0)
        go = go[text[a[go]] == text[b[go]]]
        a[go] += 1
        b[go] += 1
        lcp[go] += 1
    return order, lcp


def intervals(lcp: np.ndarray, least: int):
    """Common-prefix intervals (prefix length, first and last place in the suffix array) by a stack scan."""
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    stack: list[tuple[int, int]] = []
    last = -2
    values = lcp[deep].tolist()
    for i, v in zip(deep.tolist(), values, strict=True):
        if i != last + 1:
            while stack:
                size, left = stack.pop()
                yield size, left, last + 1
            stack.append((v, i))
        else:
            left = i
            while stack and stack[-1][0] > v:
                size, left = stack.pop()
                yield size, left, i
            if not stack or stack[-1][0] < v:
                stack.append((v, left))
        last = i
    while stack:
        size, left = stack.pop()
        yield size, left, last + 1


def maximal_repeats(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray, least: int = LENGTH):
    """Maximal repeats among the places `at` of contexts laid end to end: (length, places of all occurrences)."""
    ends = np.repeat(starts + lengths, lengths)
    begins = np.repeat(starts, lengths)
    order, lcp = suffix_array(text, ends, at)
    for size, i, j in intervals(lcp, least):
        places = order[i : j + 1]
        before = np.where(places > begins[places], text[places - 1].astype(np.int16), -1)
        if (before[0] < 0) or (before != before[0]).any():
            yield size, places


def repeats(data, anchor, place, start, lengths, doc, offset, length: int = LENGTH):
    """Spans (doc, begin, end) of all but the first occurrence of what the contexts of a bucket have in common."""
    out: list[tuple] = []
    many = np.unique(anchor, return_inverse=True, return_counts=True)
    live = np.flatnonzero(many[2][many[1]] > 1)
    if not len(live):
        return np.zeros((0, 3), np.int64)
    cut = lambda keep: (anchor[keep], place[keep], start[keep], lengths[keep], doc[keep], offset[keep])
    anchor, place, start, lengths, doc, offset = cut(live)
    first = first_of_equal(data, anchor, place, start, lengths, doc, offset)
    later = (first != np.arange(len(first))) & ((doc != doc[first]) | (offset != offset[first]))
    out.append(np.stack([doc[later], offset[later], offset[later] + lengths[later]], 1))
    anchor, place, start, lengths, doc, offset = cut(np.flatnonzero(first == np.arange(len(first))))
    many = np.unique(anchor, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(many[2][many[1]] > 1)
    keep = keep[np.argsort(anchor[keep], kind="stable")]
    anchor, place, start, lengths, doc, offset = cut(keep)
    lo = 0
    sizes = np.cumsum(lengths)
    while lo < len(anchor):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + ARRAY)))
        while hi < len(anchor) and anchor[hi] == anchor[hi - 1]:
            hi += 1
        part = slice(lo, hi)
        lo = hi
        text = data[ragged(start[part], lengths[part])]
        at = np.cumsum(lengths[part]) - lengths[part]
        windows = ragged(at, lengths[part] - length + 1)
        owner = np.repeat(np.arange(len(at)), lengths[part] - length + 1)
        hashes = window_hashes(prefix_sums(text), windows, length)
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[order] = np.append(same, False) | np.append(False, same)
        if not twice.any():
            continue
        # contexts without a repeated window leave; the rest make the suffix array
        stay = np.unique(owner[twice])
        new_at = np.zeros(len(at), np.int64)
        ls = lengths[part][stay]
        new_at[stay] = np.cumsum(ls) - ls
        small = text[ragged(at[stay], ls)]
        spots = windows[twice] - at[owner[twice]] + new_at[owner[twice]]
        d, o = doc[part][stay], offset[part][stay]
        begin = np.cumsum(ls) - ls
        who = np.repeat(np.arange(len(ls)), ls)
        for size, places in maximal_repeats(small, begin, ls, spots, length):
            w = who[places]
            key_d, key_o = d[w], o[w] + places - begin[w]
            least = np.lexsort((key_o, key_d))[0] if len(w) > 2 else (0 if (key_d[0], key_o[0]) <= (key_d[1], key_o[1]) else 1)
            rest = (key_d != key_d[least]) | (key_o != key_o[least])
            out.append(np.stack([key_d[rest], key_o[rest], key_o[rest] + size], 1))
    return np.concatenate(out)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (doc, begin, end) sorted, overlapping and touching ones joined."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    far = np.int64(1) << 40
    number = np.cumsum(np.append(0, spans[1:, 0] != spans[:-1, 0]))
    reach = np.maximum.accumulate(number * far + spans[:, 2])
    new = np.append(True, number[1:] * far + spans[1:, 1] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], spans[new, 1], reach[last] - number[last] * far], 1)


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_SPANS, _CONTEXTS = -1, (np.uint64, np.uint8, np.uint8, np.int64, np.int64, np.uint8)


def _runs(values: np.ndarray, also: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places (i, j) of the runs of equal values (and of equal values in also)."""
    if not len(values):
        return []
    new = values[1:] != values[:-1]
    if also is not None:
        new |= also[1:] != also[:-1]
    cuts = np.flatnonzero(np.append(True, new)).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True))


def _table(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def spark_hash(x: np.ndarray) -> np.ndarray:
    """The hash by which repartition() deals longs (Murmur3, 32 bits, seed 42)."""
    turned = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    words, h = x.astype(np.int64).view(np.uint32).reshape(-1, 2), np.full(len(x), 42, np.uint32)
    for k in range(2):
        h = h ^ (turned(words[:, k] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def bucket_keys(n: int) -> np.ndarray:
    """A key for each of n buckets, such that repartition(n) deals each to a partition of its own: numbers dealt by
    their hashes would leave some partitions empty and give others three or four buckets."""
    keys, at, step = np.full(n, -1, np.int64), 0, 4 * n + 64
    while (keys < 0).any():
        x = np.arange(at, at + step)
        place, first = np.unique(np.mod(spark_hash(x), n), return_index=True)
        new = keys[place] < 0
        keys[place[new]] = x[first[new]]
        at += step
    return keys


def bucket_of(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The bucket of each document, whatever steps their ids go in."""
    return keys[(common.mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(len(keys))).astype(np.int64)]


def packed_documents(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """bucket, block: the documents (id, whether the id is null, length, bytes) of each bucket, compressed."""

    def block(parts: list) -> bytes:
        ids, null, lengths, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        return packed(ids, null, lengths, data)

    def each(batches):
        held, size = defaultdict(list), 0

        def flush():
            return _table(["bucket", "block"], [pa.int64(), pa.binary()], [(b, block(parts)) for b, parts in held.items()])

        for batch in common.slices(batches, "text", 8 << 20):
            data, offs = common.text_bytes(batch.column(1))
            null = np.asarray(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            ids = batch.column(0).fill_null(0).to_numpy()
            bucket = bucket_of(ids, keys)
            bucket[null] = keys[np.arange(null.sum()) % len(keys)]  # nothing is removed from these: any bucket will do
            order = np.argsort(bucket, kind="stable")
            lengths = np.diff(offs)
            for i, j in _runs(bucket[order]):
                k = order[i:j]
                held[int(bucket[k[0]])].append((ids[k], null[k].astype(np.uint8), lengths[k], gathered(data, offs[k], lengths[k])))
            size += len(data)
            if size > PACK:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "bucket long, block binary").repartition(len(keys), "bucket")


class Bucket:
    """The documents of a bucket by id, end to end."""

    def __init__(self, blocks: pa.Table):
        parts = [unpacked(b, np.int64, np.uint8, np.int64, np.uint8) for b in blocks.column("block").to_pylist()]
        ids, null, lengths, data = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8),
            np.zeros(0, np.int64), np.zeros(0, np.uint8))
        begin = np.cumsum(lengths) - lengths
        order = np.lexsort((lengths, ids, null))
        self.ids, self.null, self.lengths = ids[order], null[order].astype(bool), lengths[order]
        self.data = gathered(data, begin[order], self.lengths)
        self.offs = np.concatenate([[0], np.cumsum(self.lengths)])

    def contexts(self, length: int, gram: int):
        """Anchor, document number, start within data, length and anchor's place of all contexts."""
        out, i, n = [], 0, int((~self.null).sum())
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offs, self.offs[i] + PIECE, "right")) - 1)
            j = min(j, n)
            lo, hi = self.offs[i], self.offs[j]
            if j == i + 1 and hi - lo > 2 * PIECE:
                for at in range(lo, max(lo + 1, hi - length + 1), PIECE):
                    end = min(hi, at + PIECE + length - 1)
                    a, d, s, ln, p = contexts(self.data[at:end], np.array([0, end - at]), length, gram)
                    out.append((a, d + i, s + at, ln, p))
            else:
                a, d, s, ln, p = contexts(self.data[lo:hi], self.offs[i : j + 1] - lo, length, gram)
                out.append((a, d + i, s + lo, ln, p))
            i = j
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4]

    def anchors(self, anchor: np.ndarray, keys: np.ndarray):
        """(context bucket, its distinct anchors by hash, how often they occur here)."""
        distinct, counts = np.unique(anchor, return_counts=True)
        hashes = common.mixed(distinct)
        to = keys[(hashes % np.uint64(len(keys))).astype(np.int64)]
        order = np.lexsort((hashes, to))
        for i, j in _runs(to[order]):
            k = order[i:j]
            yield int(to[k[0]]), distinct[k], hashes[k] >> np.uint64(24), counts[k]


def _five(h: np.ndarray) -> bytes:
    """Numbers under 2**40 in five bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def split_contexts(data, anchor, start, lengths, length: int, gram: int):
    """Contexts cut where the smallest hashes near the ends of their windows change; these make up the new anchors."""
    zone, out = min(ZONE, length - gram + 1), []
    for i, j in _chunks(lengths, PIECE):
        flat, n = gathered(data, start[i:j], lengths[i:j]), lengths[i:j]
        at = np.cumsum(n) - n
        least = common.mixed(window_hashes(prefix_sums(flat), np.arange(len(flat) - gram + 1), gram) ^ np.uint64(0xA0761D6478BD642F))
        size = 1
        while 2 * size <= zone:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < zone:
            least = np.minimum(least[: len(least) - (zone - size)], least[zone - size :])
        windows = ragged(at, n - length + 1)
        owner = np.repeat(np.arange(j - i), n - length + 1)
        key = common.mixed(least[windows] + least[windows + length - gram + 1 - zone] * np.uint64(3)) ^ anchor[i:j][owner]
        runs = np.array(_runs(key, owner), np.int64).reshape(-1, 2)
        first, last = runs[:, 0], runs[:, 1] - 1
        out.append((key[first], start[i:j][owner[first]] + windows[first] - at[owner[first]], windows[last] - windows[first] + length, owner[first] + i))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]


def repeated_anchors(texts: DataFrame, keys: np.ndarray, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """bucket (of documents), context_bucket, bits, hot: for each of its distinct anchors whether it occurs more than
    once, and whether it does so `hot` times or more."""

    def own(blocks: pa.Table) -> pa.Table:
        b = Bucket(blocks)
        source = blocks.column("bucket")[0].as_py()
        rows = [(to, source, _five(h), np.packbits(c > 1).tobytes(), np.minimum(c[c > 1], 65535).astype("<u2").tobytes()) for to, _, h,
            c in b.anchors(b.contexts(length, gram)[0], keys)]
        return pa.Table.from_batches([_table(["context_bucket", "bucket", "hashes", "twice", "counts"], [pa.int64(), pa.int64(), *[pa.binary()] * 3], rows)])

    def counted(twice: bytes, counts: bytes, n: int) -> np.ndarray:
        out = np.ones(n)
        out[np.unpackbits(np.frombuffer(twice, np.uint8), count=n).astype(bool)] = np.frombuffer(counts, "<u2")
        return out

    def meet(batches):
        held = defaultdict(list)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[row[0]].append(row[1:])
        for to, rows in held.items():
            hashes = [_from_five(r[1]) for r in rows]
            counts = [counted(*r[2:], len(h)) for r, h in zip(rows, hashes, strict=True)]
            _, number = np.unique(np.concatenate(hashes), return_inverse=True)
            count = np.bincount(number, weights=np.concatenate(counts))[number]
            again, is_hot = count > 1, count >= hot
            bits, at = [], 0
            for r, h in zip(rows, hashes, strict=True):
                part = slice(at, at + len(h))
                bits.append((r[0], to, np.packbits(again[part]).tobytes(), np.packbits(is_hot[part]).tobytes()))
                at += len(h)
            yield _table(["bucket", "context_bucket", "bits", "hot"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], bits)

    sent = texts.groupBy("bucket").applyInArrow(own, "context_bucket long, bucket long, hashes binary, twice binary, counts binary")
    return sent.repartition(len(keys), "context_bucket").mapInArrow(meet, "bucket long, context_bucket long, bits binary, hot binary")


def _span_block(spans: np.ndarray) -> bytes:
    return packed(spans[:, 0], spans[:, 1], spans[:, 2] - spans[:, 1])


def context_blocks(texts: DataFrame, anchors: DataFrame, keys: np.ndarray, length: int, gram: int) -> DataFrame:
    """Blocks of contexts by context bucket; with kind -1 those of spans that are repeats within one bucket of documents."""

    def own(blocks: pa.Table, bits: pa.Table) -> pa.Table:
        rows = []
        b = Bucket(blocks)
        anchor, who, start, lengths, place = b.contexts(length, gram)
        flags = dict(zip(bits.column("context_bucket").to_pylist(), zip(bits.column("bits").to_pylist(), bits.column("hot").to_pylist(), strict=True), strict=True))
        set_ = lambda d, raw: d[np.unpackbits(np.frombuffer(raw, np.uint8), count=len(d)).astype(bool)]
        own_anchors = [(to, d) for to, d, _, _ in b.anchors(anchor, keys)]
        wanted, hot = [set_(d, flags[to][0]) for to, d in own_anchors], [set_(d, flags[to][1]) for to, d in own_anchors]
        if wanted:
            keep = np.flatnonzero(np.isin(anchor, np.concatenate(wanted)))
            anchor, who, start, lengths, place = anchor[keep], who[keep], start[keep], lengths[keep], place[keep]
            doc, offset = b.ids[who], start - b.offs[who]
            first = first_of_equal(b.data, anchor, place, start, lengths, doc, offset)
            once = first == np.arange(len(first))
            later = ~once & ((doc != doc[first]) | (offset != offset[first]))
            if later.any():
                spans = merged(np.stack([doc[later], offset[later], offset[later] + lengths[later]], 1))
                rows.append((blocks.column("bucket")[0].as_py(), _SPANS, _span_block(spans)))
            anchor, start, lengths, place, doc, offset = (x[once] for x in (anchor, start, lengths, place, doc, offset))
            is_hot = np.isin(anchor, np.concatenate(hot))
            if is_hot.any():
                h = np.flatnonzero(is_hot)
                key, at, size, whose = split_contexts(b.data, anchor[h], start[h], lengths[h], length, gram)
                whose = h[whose]
                cold = ~is_hot
                join = lambda old, new: np.concatenate([old[cold], new])
                anchor, offset, doc = join(anchor, key), join(offset, offset[whose] + at - start[whose]), join(doc, doc[whose])
                start, lengths, place = join(start, at), join(lengths, size), join(place, np.zeros(len(key), np.int64))
            to = keys[(common.mixed(anchor) % np.uint64(len(keys))).astype(np.int64)]
            keep = np.argsort(to, kind="stable")
            to = to[keep]
            for i, j in _runs(to):
                k = keep[i:j]
                rows.append((int(to[i]), 0, packed(anchor[k], place[k].astype(np.uint8), lengths[k].astype(np.uint8), doc[k], offset[k], gathered(b.data, start[k], lengths[k]))))
        return pa.Table.from_batches([_table(["bucket", "kind", "block"], [pa.int64(), pa.int32(), pa.binary()], rows)])

    return texts.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(own, "bucket long, kind int, block binary").repartition(len(keys), "bucket")


def span_blocks(blocks: DataFrame, keys: np.ndarray, length: int) -> DataFrame:
    """Blocks of repeated spans by bucket of documents, from all blocks of contexts."""

    def each(batches):
        held = defaultdict(list)
        for batch in batches:
            for bucket, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _SPANS:
                    yield _table(["bucket", "block"], [pa.int64(), pa.binary()], [(bucket, block)])
                else:
                    held[bucket].append(block)
        while held:
            parts = list(zip(*(unpacked(b, *_CONTEXTS) for b in held.popitem()[1]), strict=True))
            anchor, place, lengths, doc, offset, data = (np.concatenate(p) for p in parts)
            lengths = lengths.astype(np.int64)
            spans = merged(repeats(data, anchor, place.astype(np.int64), np.cumsum(lengths) - lengths, lengths, doc, offset, length))
            to = bucket_of(spans[:, 0], keys)
            order = np.argsort(to, kind="stable")
            for i, j in _runs(to[order]):
                yield _table(["bucket", "block"], [pa.int64(), pa.binary()], [(int(to[order[i]]), _span_block(spans[order[i:j]]))])

    return blocks.mapInArrow(each, "bucket long, block binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept binary, kept_sha256 string"


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = True, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row per document: doc_id, its removed spans, the kept bytes (null without with_kept) and their SHA-256.

    Other columns of docs are not carried along: join on doc_id.
    """
    if not 8 <= gram <= length or 2 * length - gram > 255:
        raise ValueError("a context must fit in 255 bytes: 8 <= gram <= length, 2 * length - gram <= 255")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = bucket_keys(max(common.hot_partitions(docs.sparkSession), -(-size // bucket_bytes)))
    texts = packed_documents(docs, keys)
    anchors = repeated_anchors(texts, keys, length, gram, hot)
    spans = span_blocks(context_blocks(texts, anchors, keys, length, gram), keys, length)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def apply(blocks: pa.Table, found: pa.Table) -> pa.Table:
        b = Bucket(blocks)
        own = [unpacked(x, np.int64, np.int64, np.int64) for x in found.column("block").to_pylist()]
        doc, begin, size = (np.concatenate([o[k] for o in own]) if own else np.zeros(0, np.int64) for k in range(3))
        cuts = merged(np.stack([doc, begin, begin + size], 1))
        lo, hi = np.searchsorted(cuts[:, 0], b.ids), np.searchsorted(cuts[:, 0], b.ids, "right")
        rows = []
        for i, doc_id in enumerate(b.ids.tolist()):
            raw, at, kept = b.data[b.offs[i] : b.offs[i + 1]].tobytes(), 0, []
            cut = [] if b.null[i] else cuts[lo[i] : hi[i], 1:].tolist()
            for x, y in cut:
                kept.append(raw[at:x])
                at = y
            kept = b"".join([*kept, raw[at:]])
            rows.append((None if b.null[i] else doc_id, len(raw), len(raw) - len(kept), len(cut), [{"begin": x, "end": y} for x, y in cut],
                kept if with_kept else None, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(apply, RESULT)
