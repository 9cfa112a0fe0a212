"""MinHash near-dedup with tensored banding.

A document is the set of its ``SHINGLE``-word shingles (lower-cased A-Z; fewer words make one shingle of the whole sequence).
Small collections of minhashes are computed, and a table key is a pair of collections: 16 collections of 4 give 120
tables of 8 minhashes from 64 minhashes in place of 960. Two documents of similarity s meet in some table if two
collections agree. ``layout`` takes as many collections as keep the chance to miss a pair at the threshold within
``MISS``: at 0.85 those 16 of 4 (missed 1.4e-4; at 0.3 met with 8e-3), at 0.8 23 of 4.

1. Rows with equal word sequences form a class; one member, the smallest id, goes on for it.
2. Keys: a member sends its id and its sketch, a bit of each of 64 minhashes, to the sorted run of each of its keys. In a run only
   those are linked whose sketches differ in no more places than all but ``SKETCH_MISS`` of the pairs at the threshold do, so
   that chance meetings link nothing. Where ``CROWD`` members of a map batch share a key, they are linked to the first of them without
   being asked, only that first one travels, and its run is linked as a whole, like any run of more than ``RUN`` members: a key of any
   size sends few rows for each batch and makes no pairs. Connected components of these links are families: every pair
   that meets in a table and is similar by its sketches is in one family.
3. Families are cut into blocks of about ``BLOCK`` members. A block receives its texts and the text of the family's smallest id,
   and links those of its members whose similarity on full sets, computed as a product of incidence matrices, reaches the threshold.
4. In families of several blocks, members that these links connect with the smallest id need not be compared with each other. The
   others are, with every member: each block of others meets each block of the family, first by sketches alone, a byte of each of 64 minhashes.
   A text goes to such a meeting only if its sketch is as like one of the other side as those of all but ``SKETCH_MISS`` of the pairs at the
   threshold are. So a group of copies of one text costs two readings of its texts, whatever its size, and texts that only share boilerplate,
   which chance meetings put into one family, are hardly sent again.
5. Connected components of all verified links are the result.

Null and empty texts, and texts without words, have an empty set, link with nothing and are kept. Null ids are not
linked, equal (id, text) rows are one. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, components, groups, local_roots, materialize, mix, ngram_hashes, shuffle_partitions

SHINGLE, NUMERATOR, DENOMINATOR = 3, 85, 100
#: Chance to miss a pair at the threshold; collections and minhashes in one, at most; members of a block.
MISS, COLLECTIONS, ROWS, BLOCK = 1.5e-4, 24, 4, 256
#: Minhashes in a sketch, at most; chance that a pair's sketches differ too much; members of a batch, and of a run, linked unasked.
SKETCH, SKETCH_MISS, CROWD, RUN = 64, 1e-6, 32, 256
#: Shingles whose columns are multiplied at once.
COLUMNS = 4096

_SALTS = mix(np.arange(1, COLLECTIONS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def layout(threshold: float) -> tuple[int, int]:
    """Number of collections and of minhashes in each, for pairs at a threshold; refuses those that cannot be met."""
    for rows in range(ROWS, 0, -1):
        agree = threshold**rows
        for n in range(2, COLLECTIONS + 1):
            if (1 - agree) ** n + n * agree * (1 - agree) ** (n - 1) <= MISS:
                return n, rows
    raise ValueError(f"no layout of {COLLECTIONS} collections misses at most {MISS} of the pairs at {threshold}")


def shingle_set(words: list[bytes], hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(ngram_hashes(hashes.of(words), n))


def sketch_limit(threshold: float, places: int) -> int:
    """Places in which the sketches of a pair at the threshold differ at most, but for a chance of ``SKETCH_MISS``."""
    p, upto = (1 - threshold) / 2, 0.0  # bits of unequal minhashes agree in half of the cases
    for k in range(places + 1):
        upto += math.comb(places, k) * p**k * (1 - p) ** (places - k)
        if 1 - upto <= SKETCH_MISS:
            return k
    return places


def equal_limit(threshold: float, places: int) -> int:
    """Places in which the long sketches of a pair at the threshold are equal at least, but for a chance of ``SKETCH_MISS``."""
    p, upto = threshold + (1 - threshold) / 256, 0.0  # bytes of unequal minhashes are equal in one case of 256
    for k in range(places + 1):
        upto += math.comb(places, k) * p**k * (1 - p) ** (places - k)
        if upto > SKETCH_MISS:
            return k
    return places


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minhashes of a set that is not empty."""
    salts, least = _SALTS[:n], None
    for at in range(0, len(shingles), 1 << 10):
        x = shingles[at : at + (1 << 10), None] * salts
        x ^= x >> np.uint64(29)
        part = x.min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def collection_keys(shingles: np.ndarray, collections: int, rows: int) -> np.ndarray:
    """One 64-bit key for each collection of minhashes of a set that is not empty."""
    return ngram_hashes_rows(minhashes(shingles, collections * rows).reshape(collections, rows))


def sketch(least: np.ndarray) -> int:
    """A bit of each of the first minhashes, as one number."""
    mixed = mix(least[:SKETCH]) & np.uint64(1)
    return int((mixed << np.arange(len(mixed), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def long_sketch(least: np.ndarray) -> bytes:
    """A byte of each of the first minhashes."""
    return (mix(least[:SKETCH]) >> np.uint64(8)).astype(np.uint8).tobytes()


def ngram_hashes_rows(rows: np.ndarray) -> np.ndarray:
    out = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for column in rows.T:
        out = mix(out ^ column)
    return out


def table_keys(collections: np.ndarray) -> np.ndarray:
    """Keys of all tables for rows of collection keys."""
    a, b = np.array(list(combinations(range(collections.shape[1]), 2))).T
    return mix(mix(collections[:, a]) ^ (collections[:, b] * np.uint64(0x9E3779B97F4A7C15)))


def _sign(shingle: int, collections: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            names, sizes, keys, sketches, longer = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = text.lower().split() if text else []
                found = shingle_set(words, hashes, shingle)
                names.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(found))
                least = minhashes(found, collections * rows) if len(found) else None
                keys.append(None if least is None else ngram_hashes_rows(least.reshape(collections, rows)).view(np.int64).tolist())
                sketches.append(None if least is None else sketch(least))
                longer.append(None if least is None else long_sketch(least))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "name": pa.array(names, pa.binary()), "n_shingles": pa.array(sizes, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.int64()), "long": pa.array(longer, pa.binary())})

    return run


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _by_key(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a batch's members in order, the member of each, and the bounds of runs of equal keys."""
    n = batch.num_rows
    keys = table_keys(batch.column("keys").flatten().to_numpy().view(np.uint64).reshape(n, -1))
    ids = batch.column("doc_id").to_numpy()
    owner = np.repeat(np.argsort(np.argsort(ids, kind="stable"), kind="stable"), keys.shape[1])  # places in order of ids
    keys = keys.ravel()
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], np.argsort(ids, kind="stable")[owner[order]]
    return keys, owner, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _send_keys(crowd: int):
    """Rows of members for the runs of their keys; of a crowd in a batch the first alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, owner, first = _by_key(batch)
            size = np.diff(np.append(first, len(keys)))
            crowded = np.repeat(size >= crowd, size)
            sent = ~crowded
            sent[first] = True
            who = owner[sent]
            columns = {c: batch.column(c).to_numpy()[who] for c in ("doc_id", "sketch")}
            yield pa.RecordBatch.from_pydict({"key": keys[sent].view(np.int64), "crowd": crowded[sent], **columns})

    return run


def _batch_links(crowd: int):
    """Links to the first of a crowd in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, owner, first = _by_key(batch)
            size = np.diff(np.append(first, len(keys)))
            ids = batch.column("doc_id").to_numpy()[owner]
            crowded = np.repeat(size >= crowd, size)
            yield _pairs([ids[crowded]], [np.repeat(ids[first], size)[crowded]])

    return run


def _run_links(limit: int):
    """Links in sorted runs: of those alike by sketch, or of all with the first where a run is crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # key, first member, and whether the run was linked as a whole, of a run longer than RUN
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "crowd", "doc_id", "sketch")]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            keys = held[0]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            done = first[-1] if len(keys) - first[-1] <= RUN else len(keys)  # a long run is linked as it comes
            a, b, carried = _links_of([x[:done] for x in held], first[first < done], carried, limit)
            held = [x[done:] for x in held]
            yield _pairs(a, b)
        if held and len(held[0]):
            keys = held[0]
            a, b, _ = _links_of(held, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), carried, limit)
            yield _pairs(a, b)

    return run


def _links_of(rows: list[np.ndarray], first: np.ndarray, carried: tuple | None, limit: int) -> tuple[list[np.ndarray], list[np.ndarray], tuple | None]:
    """Links of whole runs, the last of which may go on if it is longer than ``RUN``."""
    keys, crowd, ids, bits = rows
    if not len(keys):
        return [], [], carried
    bits = bits.view(np.uint64)
    size = np.diff(np.append(first, len(keys)))
    head = np.repeat(first, size)
    head_id = ids[head]
    whole = np.logical_or.reduceat(crowd, first) | (size > RUN)
    if carried is not None and keys[0] == carried[0]:
        head_id[: size[0]] = carried[1]
        whole[0] = True
    apart = np.bitwise_count(bits ^ bits[head])
    like = apart <= limit
    to_head = np.repeat(whole, size) | like
    a, b = [ids[to_head]], [head_id[to_head]]
    for k in np.flatnonzero(~np.logical_and.reduceat(like, first) & ~whole & (size > 2)).tolist():
        part = slice(first[k], first[k] + size[k])
        i, j = np.nonzero(np.bitwise_count(bits[part, None] ^ bits[None, part]) <= limit)
        i, j = i[i < j], j[i < j]
        root = local_roots(size[k], i, j)
        a.append(ids[part])
        b.append(ids[part][root])
    moved = [x != y for x, y in zip(a, b, strict=True)]
    last = (keys[-1], head_id[-1]) if whole[-1] else None
    return [x[m] for x, m in zip(a, moved, strict=True)], [y[m] for y, m in zip(b, moved, strict=True)], last


def linked_pairs(sets: list[np.ndarray], split: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of sets whose similarity reaches numerator / denominator.

    ``split``: if over 0, only pairs between the first ``split`` sets and the others, else all pairs.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    left, right = (np.arange(split), np.arange(split, len(sets))) if split else (np.arange(len(sets)),) * 2
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1  # a shingle of one set adds to no intersection
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    common = np.zeros((len(left), len(right)), np.float32)
    columns = int(shared.sum())
    edges = np.searchsorted(number, np.arange(0, columns + COLUMNS, COLUMNS))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        dense = np.zeros((len(sets), min(COLUMNS, columns - k * COLUMNS)), np.float32)
        dense[owner[part], number[part] - k * COLUMNS] = 1
        common += dense[left] @ dense[right].T
    common = common.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    a, b = np.nonzero((denominator * common >= numerator * union) & (left[:, None] != right[None, :]))
    return left[a], right[b]


def _verify(shingle: int, numerator: int, denominator: int):
    """Verified links of units ``family, low, high``: between its two sides, or among all where it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held_a: list[int] = []
        held_b: list[int] = []
        for _, rows in groups(batches, ["family", "low", "high"]):
            ids, side = rows.column("doc_id").to_numpy(), rows.column("side").to_numpy()
            split = int((side == 0).sum()) if side.any() else 0
            if len(ids) < 2 or side.any() and not split:
                continue
            order = np.lexsort((ids, side))
            texts = rows.column("text")
            sets = [shingle_set(texts[int(i)].as_py().lower().split(), hashes, shingle) for i in order]
            ids = ids[order]
            a, b = linked_pairs(sets, split, numerator, denominator)
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            root = local_roots(len(ids), place[a], place[b])
            moved = np.flatnonzero(ids[by_id] != ids[by_id][root])
            held_a += ids[by_id][moved].tolist()
            held_b += ids[by_id][root[moved]].tolist()
            if len(held_a) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(held_a, pa.int64()), "b": pa.array(held_b, pa.int64())})
                held_a, held_b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(held_a, pa.int64()), "b": pa.array(held_b, pa.int64())})

    return run


def alike(left: np.ndarray, right: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two arrays of long sketches are equal in ``least`` places or more to some row of the other, of another id."""
    some_left, some_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for k, row in enumerate(left):
        like = (np.count_nonzero(right == row, axis=1) >= least) & (right_ids != left_ids[k])
        some_left[k] = like.any()
        some_right |= like
    return some_left, some_right


def _meetings(least: int):
    """Of units ``family, low, high`` the members of both sides whose long sketch is like one of the other side's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, low, high), rows in groups(batches, ["family", "low", "high"]):
            ids, side = rows.column("doc_id").to_numpy(), rows.column("side").to_numpy()
            bits = np.frombuffer(b"".join(rows.column("long").to_pylist()), np.uint8).reshape(len(ids), -1)
            parts = [np.flatnonzero(side == k) for k in (0, 1)]
            kept = np.concatenate([part[some] for part, some in zip(parts, alike(*(bits[p] for p in parts), *(ids[p] for p in parts), least), strict=True)])
            if not len(kept):
                continue
            columns = {"doc_id": ids[kept], "family": np.full(len(kept), family), "low": np.full(len(kept), low), "high": np.full(len(kept), high), "side": side[kept].astype(np.int32)}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})

    return run


def _up_to(n: Column) -> Column:
    """Rows for 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``, other columns ignored.

    Documents are linked if ``denominator * |A and B| >= numerator * |A or B|``; a component is named by its smallest id and
    keeps that document. A pair at the threshold is missed with probability ``MISS + SKETCH_MISS`` at most, one above it less often; a
    threshold too low for that is refused.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shuffle_partitions(spark)
    threshold = numerator / denominator
    collections, rows = layout(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = materialize(docs.mapInArrow(_sign(shingle, collections, rows), "doc_id long, name binary, n_shingles long, keys array<long>, sketch long, long binary"), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("keys", "sketch", "long")).alias("f"))
    classes = materialize(classes.select("name", "doc_id", "f.keys", "f.sketch", "f.long"), "classes")
    members = classes.select("doc_id", "keys", "sketch")
    runs = members.mapInArrow(_send_keys(CROWD), "key long, crowd boolean, doc_id long, sketch long").repartition(parts, "key").sortWithinPartitions("key", "doc_id")
    limit = sketch_limit(threshold, min(SKETCH, collections * rows))
    links = members.mapInArrow(_batch_links(CROWD), "a long, b long").unionByName(runs.mapInArrow(_run_links(limit), "a long, b long"))
    family = components(links)
    sizes = family.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    placed = family.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    placed = materialize(placed, "families")
    first = F.when(F.col("doc_id") == F.col("family"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    kind = "a long, b long"

    def verified(units: DataFrame) -> DataFrame:
        units = units.repartition(parts, "family", "low", "high").sortWithinPartitions("family", "low", "high")
        return materialize(units.mapInArrow(_verify(shingle, numerator, denominator), kind), "verified")

    units = docs.join(placed, "doc_id").select("doc_id", "text", "family", F.explode(first).alias("low"))
    inside = verified(units.select("doc_id", "text", "family", "low", F.lit(0).cast("long").alias("high"), F.lit(0).alias("side")))
    closed = components(inside)
    if not placed.where("blocks > 1").isEmpty():  # large families still have to compare those not connected with the smallest id, with all
        large = placed.where("blocks > 1").join(closed.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        large = large.withColumn("open", F.coalesce("component", "doc_id") != F.col("family"))
        left = materialize(large.groupBy("family").agg(F.ceil(F.count_if("open") / F.lit(BLOCK)).alias("others")).where("others > 0"), "others")
        other = F.when(F.col("open"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("others")))
        large = materialize(large.join(left, "family").select("doc_id", "family", "blocks", "block", "others", other.alias("other")), "open")
        members = large.join(classes.select("doc_id", "long"), "doc_id")
        mine = members.where("other is not null").select("doc_id", "long", "family", F.col("other").alias("low"), _up_to(F.col("blocks")).alias("high"), F.lit(0).alias("side"))
        theirs = members.select("doc_id", "long", "family", _up_to(F.col("others")).alias("low"), F.col("block").alias("high"), F.lit(1).alias("side"))
        units = mine.unionByName(theirs).repartition(parts, "family", "low", "high").sortWithinPartitions("family", "low", "high")
        least = equal_limit(threshold, min(SKETCH, collections * rows))
        met = materialize(units.mapInArrow(_meetings(least), "doc_id long, family long, low long, high long, side int"), "meetings")
        sent = docs.join(met, "doc_id").select("doc_id", "text", "family", "low", "high", "side")
        closed = components(inside.unionByName(verified(sent)))
    named = classes.select("name", F.col("doc_id").alias("head")).join(closed.select(F.col("node").alias("head"), "component"), "head", "left")
    named = named.select("name", F.coalesce("component", "head").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "name").join(named, "name", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
