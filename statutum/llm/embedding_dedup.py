"""Embedding near-dedup by random-hyperplane sign hashing in several tables with exact verification.

1. Equal vectors form a class that goes on as one row with its number of members.
2. Each class gets a ``bits``-bit sign code in each of ``tables`` tables. ``bits`` grows with the logarithm of the number of
   classes, so that buckets keep their size, and ``tables`` is the number that misses a pair at the threshold with
   probability ``MISS`` at most. The codes of the first tables, 128 signs, are the class's sketch.
3. To its bucket in each table a class sends its id and its sketch, 16 bytes, and no vector. Buckets that a hashed share of the
   classes shows to be larger than ``BLOCK`` are cut into blocks, every pair of blocks being a unit of its own, so that no task holds
   a whole large bucket. A unit names the classes that have a partner there: one whose sketch differs in so few signs as
   all but ``SKETCH_MISS`` of the pairs at the threshold do, and with which it did not yet meet in a table of the sketch.
4. Only for those do the vectors travel to the unit, which computes all cosines in double precision as a matrix product.
   A pair is counted in the first table where its codes meet, hence once. A unit returns for each class the number of members
   newly linked, and the least class that it reaches by links in the unit: no pairs are made.
5. Distributed connected components over those.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; they have 0 links and their own
component. Vectors of different lengths never link. Rows with null ids get a null component and are kept; rows with equal ids are
vectors of their own, linked like others. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import bounded_batches, components, local_roots, materialize, numbered_runs, shuffle_partitions

THRESHOLD = 0.95
#: Chance that a pair at the threshold meets in no table, and that its sketches differ too much; of chance.
MISS, SKETCH_MISS, SEED = 1e-5, 1e-7, 7
#: Classes for each bucket, about; rows in a block, about; one class in so many is counted to find large buckets.
FILL, BLOCK, COUNTED = 32, 512, 16
#: Signs of a sketch; bits of a bucket's key for its code and for its table.
SKETCH, CODE_BITS, TABLE_BITS = 128, 40, 10


def shape(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a code and number of tables for n classes."""
    bits = max(4, min(CODE_BITS, round(math.log2(max(2, n) / FILL))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-meet))


def sketch_limit(threshold: float = THRESHOLD) -> int:
    """Signs in which the sketches of a pair at the threshold differ at most, but for a chance of ``SKETCH_MISS``."""
    p, upto = math.acos(threshold) / math.pi, 0.0
    for k in range(SKETCH + 1):
        upto += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if 1 - upto <= SKETCH_MISS:
            return k
    return SKETCH


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, max(SKETCH, tables * bits)))


def in_sketch(bits: int, tables: int) -> list[tuple[int, int]]:
    """Tables whose codes lie in the sketch: half of the sketch and place of the first bit."""
    per = SKETCH // 2 // bits
    return [(k // per, k % per * bits) for k in range(min(tables, 2 * per))]


def _codes(bits: int, tables: int, kind: np.dtype):
    weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    half = np.left_shift(np.uint64(1), np.arange(SKETCH // 2, dtype=np.uint64))
    per = SKETCH // 2 // bits * bits  # signs in a half that are whole codes; the rest are signs from the end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = part.column("vector").flatten().to_numpy().reshape(-1, dim)
                if dim not in made:
                    made[dim] = planes(dim, bits, tables)
                signs = (x.astype(np.float64) @ made[dim]) >= 0
                codes = (signs[:, : tables * bits].reshape(len(x), tables, bits) * weights).sum(axis=2)
                rest = SKETCH // 2 - per
                halves = [np.concatenate([signs[:, j * per : (j + 1) * per], signs[:, signs.shape[1] - (j + 1) * rest : signs.shape[1] - j * rest]], axis=1) for j in (0, 1)]
                s0, s1 = ((h * half).sum(axis=1, dtype=np.uint64).view(np.int64) for h in halves)
                packed = np.packbits(signs[:, : tables * bits], axis=1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": part.column("node"),
                        "members": part.column("members"),
                        "raw": pa.array([r.tobytes() for r in np.ascontiguousarray(x, kind)], pa.binary()),
                        "dim": pa.array(np.full(len(x), dim), pa.int32()),
                        "codes": pa.array(codes.tolist(), pa.list_(pa.int64())),
                        "packed": pa.array([r.tobytes() for r in packed], pa.binary()),
                        "s0": s0,
                        "s1": s1,
                    }
                )

    return run


def _partners(bits: int, tables: int, limit: int):
    """Classes of units that have a partner in them, by sketches."""
    places, mask = in_sketch(bits, tables), np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for key, place, ids, s0, s1 in numbered_runs(batches, ["key", "place", "node", "s0", "s1"], lambda key, place, *_: (key, place >> 1)):
            split = int(np.searchsorted(place & 1, 1))
            one = int(place[0] >> 33) == int(place[0] >> 1) & 0xFFFFFFFF
            left, right = (slice(None), slice(None)) if one else (slice(0, split), slice(split, None))
            if len(ids) < 2 or not one and split in (0, len(ids)):
                continue
            sketch = (s0.view(np.uint64), s1.view(np.uint64))
            apart = sum(np.bitwise_count(s[left, None] ^ s[None, right]) for s in sketch)
            a, b = np.nonzero(apart <= limit)
            if one:
                a, b = a[a < b], b[a < b]
            else:
                b = b + split
            table = int(key[0] >> CODE_BITS) & ((1 << TABLE_BITS) - 1)
            for half, first in places[:table]:
                if len(a):
                    code = (sketch[half] >> np.uint64(first)) & mask
                    fresh = code[a] != code[b]
                    a, b = a[fresh], b[fresh]
            if len(a):
                some = np.union1d(a, b)
                held.append((key[some], place[some], ids[some]))
                size += len(some)
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["key", "place", "node"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["key", "place", "node"])

    return run


def _compare(threshold: float, bits: int, tables: int, kind: np.dtype):
    """Links of the classes of a unit by exact cosines."""
    weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))

    def unit(key: int, one: bool, second: np.ndarray, ids: np.ndarray, members: np.ndarray, raw: np.ndarray, packed: np.ndarray) -> pa.RecordBatch | None:
        n, split = len(ids), int(np.searchsorted(second, True))
        if n < 2 or not one and split in (0, n):
            return None
        x = np.frombuffer(b"".join(raw), kind).reshape(n, -1).astype(np.float64)
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        signs = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(n, -1), axis=1)[:, : tables * bits]
        codes = (signs.reshape(n, tables, bits) * weights).sum(axis=2)
        left, right = (slice(None), slice(None)) if one else (slice(0, split), slice(split, None))
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        if one:
            a, b = a[a < b], b[a < b]
        else:
            b = b + split
        table = key >> CODE_BITS & ((1 << TABLE_BITS) - 1)
        if table and len(a):
            fresh = np.ones(len(a), bool)
            for k in range(table):  # a table at a time: all at once would take as many numbers as pairs times tables
                fresh &= codes[a, k] != codes[b, k]
            a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        links = np.bincount(a, members[b], n).astype(np.int64) + np.bincount(b, members[a], n).astype(np.int64)
        by_id = np.argsort(ids, kind="stable")
        at = np.empty(n, np.int64)
        at[by_id] = np.arange(n)
        root = ids[by_id][local_roots(n, at[a], at[b])][at]
        some = links > 0
        return pa.RecordBatch.from_pydict({"node": ids[some], "links": links[some], "root": root[some]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, place, ids, members, raw, packed in numbered_runs(batches, ["key", "place", "node", "members", "raw", "packed"], lambda key, place, *_: (key, place >> 1)):
            one = int(place[0] >> 33) == int(place[0] >> 1) & 0xFFFFFFFF
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes).tolist():  # lengths that differ by a multiple of 8192 share keys
                of = sizes == size
                links = unit(int(key[0]), one, (place & 1 == 1)[of], ids[of], members[of], raw[of], packed[of])
                if links is not None:
                    yield links

    return run


def vector_name(vector: Column) -> Column:
    """16 bytes that name a vector."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), vector)), 16, "0") for k in (0, 1))))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``, other columns ignored."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    parts = shuffle_partitions(spark)
    given = vectors.schema["embedding"].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    element, kind = ("float", np.dtype("<f4")) if single else ("double", np.dtype("<f8"))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~odd & F.exists("vector", lambda v: v != 0), F.lit(False))
    # Doubles are scaled by the largest component: no product overflows or vanishes, and no cosine changes. Floats need none of it.
    scale = F.lit(1.0).cast("float") if single else F.array_max(F.transform("vector", lambda v: F.abs(v)))
    plain = F.transform("vector", lambda v: ((v if single else v / scale) + F.lit(0.0)).cast(element))
    rows = vectors.withColumn("vector", F.when(sound, plain)).withColumn("name", F.when(F.col("vector").isNotNull(), vector_name(F.col("vector"))))
    classes = rows.where("vector is not null").groupBy("name").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bits, tables = shape(classes.count(), threshold)
    if tables >= 1 << TABLE_BITS:
        raise ValueError(f"a threshold of {threshold} needs {tables} tables")
    schema = "node long, members long, raw binary, dim int, codes array<long>, packed binary, s0 long, s1 long"
    coded = materialize(classes.select("node", "members", "vector").mapInArrow(_codes(bits, tables, kind), schema), "codes")
    bucket = F.shiftleft(F.pmod(F.col("dim"), F.lit(8192)).cast("long"), CODE_BITS + TABLE_BITS).bitwiseOR(F.shiftleft(F.col("table").cast("long"), CODE_BITS)).bitwiseOR(F.col("code"))
    sent = coded.select("node", "s0", "s1", "dim", F.posexplode("codes").alias("table", "code")).select(bucket.alias("key"), "node", "s0", "s1")
    counted = sent.where(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(COUNTED)) == 0).groupBy("key").agg((F.count(F.lit(1)) * COUNTED).alias("n")).where(F.col("n") > BLOCK)
    large = materialize(counted.select("key", F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks")), "large")
    placed = sent.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    place = F.shiftleft(low, 33).bitwiseOR(F.shiftleft(high, 1)).bitwiseOR(F.when(F.col("block") > F.col("other"), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    unit = F.shiftright("place", 1)
    units = placed.select("key", place.alias("place"), "node", "s0", "s1").repartition(parts, "key", unit).sortWithinPartitions("key", "place")
    met = units.mapInArrow(_partners(bits, tables, sketch_limit(threshold)), "key long, place long, node long")
    chosen = met.join(coded.select("node", "members", "raw", "packed"), "node").select("key", "place", "node", "members", "raw", "packed")
    chosen = chosen.repartition(parts, "key", unit).sortWithinPartitions("key", "place")
    found = materialize(chosen.mapInArrow(_compare(threshold, bits, tables, kind), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(classes.select("node", "least"), "node")
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = joined.select("node", "component").join(named, "component").select("node", "component_id")
    by_class = classes.select("name", "node", "least", "members").join(links, "node", "left").join(joined, "node", "left")
    by_class = by_class.select("name", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "name").join(by_class, "name", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
