"""Near-duplicate documents: MinHash bands, odd sketches for candidates, exact Jaccard on full shingle sets.

1. Each text becomes the set of its distinct 5-word shingles (a shorter one its whole word sequence), a digest
   of that set, BANDS hashes of ROWS MinHash values each, and an odd sketch: every MinHash value flips one bit.
2. Documents with equal sets are one class, named by its smallest doc_id; only one of them goes on.
3. Candidates are classes that share a band's hash and whose sketches estimate a similarity of SKETCH_LEAST (XOR and
   population count). In each band's bucket all classes are estimated against the smallest one, its lead; only those
   unlike the lead are estimated against all others of the bucket. That gives ties, at most one for a class and band,
   never all pairs. Sharing a band alone ties nothing.
4. The ties' connected components are the blocks in which links can lie. Within a block candidates are
   confirmed on the full sets: one class is compared with all, then only those that it is not connected with are.
5. A block of over 128 KB is not left to one task: its classes are compared with the block's smallest class in
   shares of that size; those that are not linked with it are dealt in parts against parts of the whole block.

Missing a pair of similarity s takes (1 - s**ROWS)**BANDS: 2e-6 at 0.75. A sketch of such a pair estimates less than
0.58 in none of 300,000 draws; the limit is 0.56. Texts are read once for the profiles and once for the classes that are in blocks.

Null, empty and wordless texts: an empty set, linked with nothing, a component of their own. doc_id is a key:
repeated rows are equal. They and equal texts share a component. Rows of a null doc_id name no class. Empty
table: empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

SHINGLE = 5
THRESHOLD = (75, 100)
ROWS, BANDS = 5, 48
SKETCH_BITS = 1024
#: Estimated similarity under which a candidate is not confirmed on full sets.
SKETCH_LEAST = 0.56
#: Texts whose signatures are computed together, at most, and their bytes.
ROWS_AT_ONCE, TEXT_AT_ONCE = 1024, 1 << 20
#: What a part of a block may have, in bytes of sets, bands and sketches, and a part of a band's bucket, in classes: the
#: least that is worth a part, and the most. A cell holds two parts.
BLOCK_BYTES = (1 << 17, 16 << 20)
BUCKET_CLASSES = (1 << 7, 1 << 14)
#: Ids, of 8 bytes each, up to which they are broadcast; more are joined by shuffle.
BROADCAST_IDS = 2_000_000

_WORD = np.ones(256, bool)
_WORD[9:14] = _WORD[32] = False
_POWERS = common.Powers()
_SEEDS = common.mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the n + 1 offsets."""
    data, offs = common.text_bytes(texts)
    data = common.LOWER[data]
    starts, ends, of = common.words_of(data, offs, _WORD)
    words = common.span_hashes(data, starts, ends, _POWERS)
    n = len(offs) - 1
    count = np.bincount(of, minlength=n)
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(total)]
    keep = np.flatnonzero(of[: len(total)] == of[width - 1 :]) if len(total) else np.zeros(0, np.int64)
    sets, owner = common.mixed(total[keep]), of[keep]
    at = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short.tolist()):
            h = np.uint64(count[i])
            for x in words[at[i] : at[i + 1]]:
                h = common.mixed(np.array([h ^ x], np.uint64))[0]
            whole[k] = h
        sets, owner = np.concatenate([sets, whole]), np.concatenate([owner, short])
    order = np.lexsort((sets, owner))
    sets, owner = sets[order], owner[order]
    new = np.append(True, (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])) if len(sets) else np.zeros(0, bool)
    sets, owner = sets[new], owner[new]
    return sets, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def signatures(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of MinHash values for each non-empty set, in order."""
    first = offs[:-1][np.diff(offs) > 0]
    out = np.zeros((len(first), len(_SEEDS)), np.uint64)
    if len(first):
        for k, seed in enumerate(_SEEDS):
            out[:, k] = np.minimum.reduceat((sets ^ (seed >> np.uint64(7))) * seed, first)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    total = np.zeros((len(sig), BANDS), np.uint64)
    parts = common.mixed(sig).reshape(len(sig), BANDS, ROWS)
    for j in range(ROWS):
        total = total * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j]
    return common.mixed(total + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def odd_sketches(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps, packed: each sample (k, value) flips the bit that its hash names."""
    k = np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = (common.mixed(sig + k) >> np.uint64(11)) % np.uint64(bits)
    flat = (at + np.arange(len(sig), dtype=np.uint64)[:, None] * np.uint64(bits)).ravel().astype(np.int64)
    return np.packbits((np.bincount(flat, minlength=len(sig) * bits) & 1).astype(np.uint8).reshape(len(sig), bits), axis=1)


def sketch_similarity(a: np.ndarray, b: np.ndarray, samples: int = ROWS * BANDS, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity estimated from the XOR population counts of packed sketches (as uint64 rows)."""
    odd = np.bitwise_count(a ^ b).sum(axis=-1).astype(float)
    return 1 - -bits / 2 * np.log(np.maximum(1e-9, 1 - 2 * odd / bits)) / (2 * samples)


def _most_odd(least: float = SKETCH_LEAST, samples: int = ROWS * BANDS, bits: int = SKETCH_BITS) -> int:
    """Odd bits up to which two sketches are estimated as similar as `least`."""
    return int(bits / 2 * (1 - np.exp((least - 1) * 4 * samples / bits)))


def _may_link(sizes: np.ndarray, size, odd: np.ndarray, threshold=THRESHOLD) -> np.ndarray:
    return (threshold[1] * np.minimum(sizes, size) >= threshold[0] * np.maximum(sizes, size)) & (odd <= _most_odd())


def _candidates(n: str, m: str, a: str, b: str, threshold=THRESHOLD):
    """The same for columns: set sizes and sketches as arrays of longs."""
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (threshold[1] * F.least(n, m) >= threshold[0] * F.greatest(n, m)) & (odd <= _most_odd())


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null if empty), bands, sketch (both empty then)."""

    def each(batches):
        for batch in common.slices(batches, "text", TEXT_AT_ONCE, ROWS_AT_ONCE):
            sets, offs = shingle_sets(batch.column(1))
            n = np.diff(offs)
            sig = signatures(sets, offs)
            bands, sketch = band_hashes(sig), odd_sketches(sig)
            keys = [hashlib.blake2b(sets[offs[i] : offs[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(len(n))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n > 0)]) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64()))
            words = np.ascontiguousarray(sketch).view(np.int64)
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n > 0)]) * words.shape[1], pa.int32()), pa.array(words.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists, kept],
                names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


class Links:
    """Union-find over the classes of one block."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self, members: np.ndarray) -> np.ndarray:
        r = self.up[members]
        while (r != (q := self.up[r])).any():
            r = q
        self.up[members] = r
        return r

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def resolve(ids: np.ndarray, bands: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], linked: np.ndarray | None = None, threshold=THRESHOLD) -> np.ndarray:
    """The smallest class reachable by links, for each class of a block (ids ascending).

    linked: flags of classes that are known to be in one component.
    """
    n = len(ids)
    links, everyone = Links(n), np.arange(n)
    known = np.flatnonzero(linked) if linked is not None else everyone[:0]
    for k in known[1:].tolist():
        links.join(int(known[0]), k)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(bands.ravel(), kind="stable")
    values, owner = bands.ravel()[order], order // bands.shape[1]
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    found = {}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=True):
        if b - a > 1:
            m = np.unique(owner[a:b])
            found[m.tobytes()] = m
    buckets = [m for m in found.values() if len(m) > 1]
    if not buckets:
        return ids
    of: list[list[int]] = [[] for _ in range(n)]
    for k, m in enumerate(buckets):
        for x in m.tolist():
            of[x].append(k)

    def confirm(x: int, others: np.ndarray) -> np.ndarray:
        """Which of others are linked with x, on the full sets."""
        own, flat = sets[x], np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
        return threshold[1] * both >= threshold[0] * (len(own) + sizes[others] - both)

    def compare(x: int) -> None:
        """Compares x with all that share a bucket with it and are not connected to it, the likeliest first."""
        mask = np.zeros(n, bool)
        for k in of[x]:
            mask[buckets[k]] = True
        others = np.flatnonzero(mask & (links.roots(everyone) != links.find(x)))
        odd = np.bitwise_count(sketches[others] ^ sketches[x]).sum(axis=-1)
        may = _may_link(sizes[others], sizes[x], odd, threshold)
        others = others[may][np.argsort(odd[may], kind="stable")]
        i, step = 0, 16
        while i < len(others):
            some = others[i : i + step]
            i, step = i + step, min(1024, 4 * step)
            some = some[links.roots(some) != links.find(x)]
            if len(some):
                for j in some[confirm(x, some)].tolist():
                    links.join(x, j)

    # a class that is in the centre's component when its turn comes needs none: whoever is outside compares with it
    centre = int(known[0]) if len(known) else int(max(buckets, key=len)[0])
    if not len(known):
        compare(centre)
    for x in range(n):
        if of[x] and links.find(x) != links.find(centre):
            compare(x)
    return ids[links.roots(everyone)]


def _alike(ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, far: np.ndarray) -> list[tuple[int, int]]:
    """Ties between each far class and what its sketch is like, unless they are connected already."""
    links, everyone, ties = Links(len(ids)), np.arange(len(ids)), []
    near = np.flatnonzero(~far)
    for k in near[1:].tolist():  # these are tied to the lead
        links.join(int(near[0]), k)
    for x in np.flatnonzero(far).tolist():
        others = np.flatnonzero(links.roots(everyone) != links.find(x))
        odd = np.bitwise_count(sketches[others] ^ sketches[x]).sum(axis=-1)
        for j in others[_may_link(sizes[others], sizes[x], odd)].tolist():
            if links.find(j) != links.find(x):
                links.join(x, j)
                ties.append((int(ids[x]), int(ids[j])))
    return ties


def _groups(batches, column: int = 0):
    """The rows of each run of equal values in a column, as lists of rows, from batches sorted by it."""
    rows, now = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[column] != now:
                yield rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield rows


def _parts(rows: DataFrame, key: str, size, far, part: tuple[int, int]) -> DataFrame:
    """_key, _all, _far: in how many parts large groups are dealt, and in how many those of them that are far.

    A part is a quarter of the far ones together, within the bounds given: all cells together then hold about eight
    times the group, unless a quarter is over the upper bound.
    """
    x = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(size).alias("n"), F.sum(F.when(far, size).otherwise(0)).alias("f"))
    own = F.greatest(F.lit(part[0]), F.least(F.lit(part[1]), F.ceil(F.col("f") / 4)))
    x = x.select("_key", F.ceil(F.col("n") / own).cast("int").alias("_all"), F.ceil(F.col("f") / own).cast("int").alias("_far"))
    return common.written(x.filter("_all > 1"), "parts")


def _cells(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """rows, of columns key, class_id, far and others, with a cell: each far row meets each other row of its group in one.

    A group in parts has a cell for each part of its far rows with each part of all its rows.
    """
    x = rows.join(parts, rows[key] == parts["_key"], "left").withColumn("_all", F.coalesce("_all", F.lit(1))).withColumn("_far", F.greatest(F.lit(1), F.coalesce("_far", F.lit(1))))
    own = F.pmod(F.xxhash64("class_id"), "_all")
    mine = F.pmod(F.xxhash64("class_id", F.lit(1)), "_far")
    pair = lambda f, a: F.struct(f.cast("long").alias("f"), a.cast("long").alias("a"))
    as_other = F.transform(F.sequence(F.lit(0), F.col("_far") - 1), lambda f: pair(f, own))
    as_far = F.when(F.col("far"), F.transform(F.sequence(F.lit(0), F.col("_all") - 1), lambda a: pair(mine, a)))
    places = F.array_distinct(F.concat(as_other, F.coalesce(as_far, F.array().cast("array<struct<f:bigint,a:bigint>>"))))
    return x.withColumn("_place", F.explode(places)).withColumn("cell", F.xxhash64(key, "_place.f", "_place.a")).drop("_place", "_key", "_all", "_far")


def ties(classes: DataFrame, bucket_classes: tuple[int, int] = BUCKET_CLASSES) -> DataFrame:
    """u, v: candidate pairs that connect whatever candidates share a band."""
    in_band = classes.select("class_id", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.min("class_id").alias("lead"), F.max("class_id").alias("last")).filter("lead < last").select("band", "lead")
    members = in_band.join(shared, "band").filter("class_id <> lead")
    of = lambda name: classes.select(F.col("class_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    x = members.join(of("class_id"), "class_id").join(of("lead"), "lead")
    x = x.withColumn("far", ~_candidates("n_class_id", "n_lead", "s_class_id", "s_lead")).select("band", "lead", "class_id", "n_class_id", "s_class_id", "far")
    x = common.written(x, "estimates")
    near = x.filter(~F.col("far")).select(F.col("class_id").alias("u"), F.col("lead").alias("v"))
    alone = common.written(x.filter("far").select("band").distinct(), "unlike")
    rest = x.join(alone, "band", "left_semi")
    rest = _cells(rest, "band", _parts(rest, "band", F.lit(1), F.col("far"), bucket_classes))
    rest = rest.select("cell", "class_id", "n_class_id", "s_class_id", "far").repartition("cell").sortWithinPartitions("cell", "class_id")

    def each(batches):
        for rows in _groups(batches):
            ids, sizes, far = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.array([r[4] for r in rows], bool)
            found = _alike(ids, sizes, np.array([r[3] for r in rows], np.int64).view(np.uint64), far)
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in found], pa.int64()) for k in range(2)], names=["u", "v"])

    return near.union(rest.mapInArrow(each, "u long, v long")).distinct()


def _resolved(cells: DataFrame) -> DataFrame:
    """class_id, component for rows (cell, class_id, bands, sketch, linked, text) sorted by cell."""

    def done(rows: list) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        ids, linked = np.array([r[0] for r in rows], np.int64), np.array([r[4] for r in rows], bool)
        got = resolve(ids, np.stack([r[1] for r in rows]), np.stack([r[2] for r in rows]), [r[3] for r in rows], linked)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(got)], names=["class_id", "component"])

    def each(batches):
        rows, now = [], None
        for batch in batches:
            for part in common.slices([batch], "text", TEXT_AT_ONCE, ROWS_AT_ONCE):
                sets, offs = shingle_sets(part.column(5))
                cell, ids, linked = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(4).to_pylist()
                bands = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
                sketches = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH_BITS // 64).view(np.uint64)
                for i, b in enumerate(cell):
                    if b != now and rows:
                        yield done(rows)
                        rows = []
                    now = b
                    rows.append((ids[i], bands[i], sketches[i], sets[offs[i] : offs[i + 1]].copy(), linked[i]))
        if rows:
            yield done(rows)

    return cells.select("cell", "class_id", "bands", "sketch", "linked", "text").repartition("cell").sortWithinPartitions("cell",
        "class_id").mapInArrow(each, "class_id long, component long")


def _with_lead(member: DataFrame, texts: DataFrame, parts: DataFrame) -> DataFrame:
    """class_id, linked: whether each class of a block in parts is linked with the block's smallest class."""
    share = lambda: F.pmod(F.xxhash64("class_id"), "_all")
    mine = member.join(parts, member["block"] == parts["_key"]).filter("class_id <> block").select("block", share().alias("share"), "class_id")
    mine = mine.join(texts, "class_id")
    lead = parts.join(texts, parts["_key"] == texts["class_id"]).select(F.col("_key").alias("_block"), F.col("text").alias("lead"),
        F.explode(F.sequence(F.lit(0), F.col("_all") - 1).cast("array<bigint>")).alias("_share"))
    x = mine.join(lead, (mine["block"] == lead["_block"]) & (mine["share"] == lead["_share"])).select("class_id", "block", "text", "lead")

    def each(batches):
        sets_of: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in common.slices([batch], "text", TEXT_AT_ONCE, ROWS_AT_ONCE):
                sets, offs = shingle_sets(part.column(2))
                blocks, linked = part.column(1).to_pylist(), []
                for i, b in enumerate(blocks):
                    if b not in sets_of:
                        sets_of.clear()
                        sets_of[b] = shingle_sets(part.column(3).slice(i, 1))[0]
                    own, other = sets[offs[i] : offs[i + 1]], sets_of[b]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    linked.append(THRESHOLD[1] * both >= THRESHOLD[0] * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(linked, pa.bool_())], names=["class_id", "linked"])

    return x.sortWithinPartitions("block").mapInArrow(each, "class_id long, linked boolean")


def _ids(ids: DataFrame) -> DataFrame:
    """A written table's ids, to be broadcast if there are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def linked_classes(docs: DataFrame, classes: DataFrame, block_bytes: tuple[int, int] = BLOCK_BYTES, bucket_classes: tuple[int, int] = BUCKET_CLASSES) -> DataFrame:
    """class_id, component for the classes that are in blocks."""
    blocks = graph.components(ties(classes, bucket_classes))
    member = classes.join(blocks, classes["class_id"] == blocks["node"]).select("class_id", "n_shingles", "bands", "sketch", F.col("component").alias("block"))
    member = common.written(member, "blocks")
    wanted = _ids(member.select(F.col("class_id").alias("_wanted")))
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), "text")
    texts = common.written(texts.join(wanted, texts["class_id"] == F.col("_wanted"), "left_semi").dropDuplicates(["class_id"]), "texts")
    weight = 8 * F.col("n_shingles") + 8 * BANDS + SKETCH_BITS // 8
    parts = common.written(member.groupBy(F.col("block").alias("_key")).agg(F.ceil(F.sum(weight) / block_bytes[0]).cast("int").alias("_all")).filter("_all > 1"), "parts")
    divided = bool(parts.limit(1).count())
    no, key = F.lit(False), member["block"] == parts["_key"]
    small = member.join(parts, key, "left_anti").select(F.col("block").alias("cell"), "class_id", "bands", "sketch", no.alias("linked"))
    if divided:
        found = common.written(_with_lead(member, texts, parts), "linked")
        big = member.join(parts, key, "left_semi").join(found, "class_id", "left").withColumn("linked", F.coalesce("linked", F.lit(True)))  # the smallest class itself
        big = common.written(big.withColumn("far", ~F.col("linked")), "big-blocks")
        unlike = common.written(big.filter("far").select("block").distinct(), "unlike")
        open_ = big.join(unlike, "block", "left_semi")
        dealt = _cells(open_, "block", _parts(open_, "block", weight, F.col("far"), block_bytes)).select("cell", "class_id", "bands", "sketch", "linked")
        small = small.withColumn("cell", F.xxhash64("cell")).unionByName(dealt)
    linked = _resolved(small.join(texts, "class_id"))
    if divided:  # a class is in several cells: what they found is joined
        with_lead = big.filter("linked").select(F.col("class_id").alias("u"), F.col("block").alias("v"))
        linked = graph.components(linked.toDF("u", "v").union(with_lead)).toDF("class_id", "component")
    return linked.groupBy("class_id").agg(F.min("component").alias("component"))


def clusters(docs: DataFrame, block_bytes: tuple[int, int] = BLOCK_BYTES, bucket_classes: tuple[int, int] = BUCKET_CLASSES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the document names its component): one row for each row of docs.

    Other columns of docs are not carried along: join on doc_id.
    """
    seen = common.written(profiles(docs), "profiles")
    full = seen.filter("set_key is not null and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.first("n_shingles").alias("n_shingles"))
    classes = common.written(classes, "classes")
    linked = linked_classes(docs, classes, block_bytes, bucket_classes)
    named = classes.select("set_key", "class_id").join(linked, "class_id", "left").select("set_key", F.coalesce("component", "class_id").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that another document of their component stands for; a repeated row stays once.

    Rows of a null doc_id stay. Only ids meet ids: docs are filtered by the ids to drop, which are broadcast if few.
    """
    found = common.written(clusters(docs.select("doc_id", "text")).filter("doc_id is not null").select("doc_id", "kept"), "kept")
    key = docs["doc_id"].cast("long")
    drop = _ids(common.written(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_drop")).distinct(), "drop"))
    left = docs.join(drop, key == F.col("_drop"), "left_anti")
    again = common.written(found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again")), "again")
    if not again.limit(1).count():
        return left
    once = left.join(again, key == F.col("_again"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, key == F.col("_again"), "left_anti").unionByName(once)
