"""Token counts of byte-level BPE by merging whole batches of ragged arrays rank by rank.

Texts are cut into pre-tokens. The distinct ones that the worker has not met yet are laid end to end as one
array of symbols; in each round every sequence merges all occurrences of its own lowest-ranked pair, and a
sequence without a mergeable pair leaves with the number of symbols that survive. A long unbroken sequence has so
many ranks that a round for each would pass over it too often: over LONG symbols its pairs are merged in the same
order, by rank and place, from a heap. Only a bounded table of counts is kept between batches.

Null and empty texts: 0 tokens. Strings of the vocabulary's added tokens inside texts count as one token.
Repeated rows get equal counts. Empty table: empty result. Other columns stay.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 300_000
#: Symbols from which on a sequence is merged by a heap, and bytes of a pre-token that is not remembered.
LONG, FORGOTTEN = 2048, 256
NONE = np.int64(1) << 40
# fixed value: the pre-token pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, inverted."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary file's merges: (left, right) pairs as sorted keys, with rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        keys, made = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] << 32 | vocab[b])
            made.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.rank = np.array(keys, np.int64)[order], order.astype(np.int64)
        self.made = np.array(made, np.int64)[order]
        chars = _byte_chars()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.table = None

    def ranks(self, symbols: np.ndarray, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that begins at each symbol (NONE if there is no merge), and its place in keys."""
        pair = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        ok = (self.keys[at] == pair) & alike
        return np.append(np.where(ok, self.rank[at], NONE), NONE), np.append(at, 0)

    def count_long(self, piece: bytes) -> int:
        """Tokens of one long piece: the pair of the lowest rank, the leftmost of several, is merged again and again."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        get, n = self.table.get, len(piece)
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self.ranks(ids, np.ones(n - 1, bool))[0][:-1]
        heap = (rank << 32 | np.arange(n - 1))[rank != NONE].tolist()
        heapq.heapify(heap)
        symbols, after, before, left = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            merge = get(symbols[i] << 32 | symbols[j])
            if merge is None or merge[0] != top >> 32:
                continue  # one of the two is another symbol by now
            symbols[i], symbols[j] = merge[1], -1
            left -= 1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if merge := get(symbols[i] << 32 | symbols[j]):
                    heapq.heappush(heap, merge[0] << 32 | i)
            if (h := before[i]) >= 0 and (merge := get(symbols[h] << 32 | symbols[i])):
                heapq.heappush(heap, merge[0] << 32 | h)
        return left

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        counts = lengths.copy()
        for k in np.flatnonzero(lengths > LONG).tolist():
            counts[k] = self.count_long(pieces[k])
            lengths[k] = 0
        pieces = [p if n else b"" for p, n in zip(pieces, lengths.tolist(), strict=True)]
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols):
            rank, at = self.ranks(symbols, seq[:-1] == seq[1:])
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(seq)))
            done = least == NONE
            counts[seq[first[done]]] = sizes[done]
            low = np.repeat(least, sizes)
            hit = (rank == low) & (low != NONE)
            # of overlapping occurrences (x x x) every second one, from the left
            place = np.flatnonzero(hit)
            if not len(place):
                break
            run = np.append(True, np.diff(place) != 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - begin) % 2 == 0]
            symbols[place] = self.made[at[place]]
            keep = np.repeat(~done, sizes)
            keep[place + 1] = False
            symbols, seq = symbols[keep], seq[keep]
        return counts


class Counter:
    """Counts texts; remembers the counts of pre-tokens up to a bound."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.merges, self.remembered, self.known = Merges(path), remembered, {}

    def _pieces(self, text: str) -> tuple[list[str], int]:
        find, added = self.merges.pattern.findall, self.merges.added
        if added is None or not added.search(text):
            return find(text), 0
        parts = added.split(text)
        return [p for part in parts for p in find(part)], len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        pieces = [self._pieces(t or "") for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        new = set()
        for ps, _ in pieces:
            new |= set(ps).difference(self.known)
        if new:
            fresh = list(new)
            self.known.update(zip(fresh, self.merges.count([p.encode() for p in fresh]).tolist(), strict=True))
        get = self.known.__getitem__
        found = [sum(map(get, ps)) + extra for ps, extra in pieces]
        for p in new:
            if len(p) > FORGOTTEN:
                del self.known[p]
        return found


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """docs with n_tokens and over_limit; columns of these names are replaced."""
    x, names = common.beside(docs, "text", ("n_tokens", "over_limit"))

    def each(batches):
        count = counter(path).count
        for batch in common.slices(batches, "text"):
            n = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["_row", "text", "n_tokens"])

    done = x.mapInArrow(each, common.extended(x.schema, n_tokens="long"))
    return done.select(*common.rejoined(names, "text"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
