"""Helpers shared by the training-data operators: shared storage, batches, row keys, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import materialize, shared_dir, shared_path  # noqa: F401

#: Arrow batches sent to Python hold at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, run: Callable, added: list[StructField], *needed: str) -> DataFrame:
    """``mapInArrow`` with columns added to all that there are; those that are not needed go by numbers meanwhile, as odd names cannot pass."""
    plain = df.toDF(*(c if c in needed else f"c{i}_" for i, c in enumerate(df.columns)))
    return plain.mapInArrow(run, StructType([*plain.schema.fields, *added])).toDF(*df.columns, *(f.name for f in added))


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct ``rest``, so that no name of theirs can clash."""
    others = [quoted(c) for c in df.columns if c not in needed]
    return df.select(*map(quoted, needed), *([F.struct(*others).alias("rest")] if others else []))


def unpacked(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The columns of the table that ``packed`` was given, in their order."""
    return df.select(*(F.col(quoted(c) if c in needed else f"rest.{quoted(c)}").alias(c) for c in columns))


def row_name(id_col: str = "doc_id", text_col: str = "text"):
    """16 bytes that name a row by its id and text: repeated ids with different texts stay apart, equal rows share it."""
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(k), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.col(text_col))), 16, "0") for k in (0, 1)]
    return F.unhex(F.concat(*halves))


#: Names that clusters give to stores, and pyarrow's for them; mounted ones are folders.
SCHEMES, MOUNTED = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasb": "abfss", "wasbs": "abfss"}, {"dbfs": "/dbfs"}


def place_of(uri: str) -> str:
    """A location as pyarrow names it."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file") or scheme in MOUNTED:
        return MOUNTED.get(scheme, "") + urlparse(uri).path
    return SCHEMES.get(scheme, scheme) + uri[len(scheme) :]


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for local and mounted folders and the stores of ``SCHEMES`` and of pyarrow."""
    from pyarrow import fs

    place = place_of(uri)
    return (fs.LocalFileSystem(), place) if place.startswith("/") else fs.FileSystem.from_uri(place)


def write_file(uri: str, chunks) -> int:
    """Write chunks of bytes under a temporary name, then rename: a task that runs twice leaves one whole file."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with system.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(temporary, path)
    return size


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of hashed words, in order."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _C + words[k : len(words) - n + 1 + k]
    return mix(out)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys in batches sorted by them; a run may go over several batches."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != current:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current, start = [], row, i
        held.append(batch.slice(start))
    if held:
        yield current, pa.Table.from_batches(held)


def numbered_runs(batches: Iterator[pa.RecordBatch], columns: list[str], key: Callable) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal keys as arrays of the columns, for batches sorted by the key.

    ``key`` takes the columns and returns arrays that a run has in common; a run may go over several batches and should be bounded.
    """
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        keys = key(*held)
        edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        start = 0
        for end in edges.tolist():
            yield [x[start:end] for x in held]
            start = end
        held = [x[start:] for x in held]
    if held:
        yield held


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the smallest node naming each.

    Every round merges each node with its least neighbour and keeps the edges between what is left. Even rounds
    order nodes by id, which closes stars at once; odd rounds order them by a hash, so that long chains shrink by a
    constant factor. A node of any degree is only ever grouped by ``min_by`` (combined before the shuffle) or met in a
    join that Spark may split; of whole numbers that needs no sort, whose pages would take most of a task's memory however few the rows. The hash of
    whole numbers has no ties. Nothing but the number of edges left reaches the driver.
    """
    a, b = F.col("a"), F.col("b")
    left = materialize(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    parents: list[DataFrame] = []
    while not left.isEmpty():
        r = len(parents)
        order = (lambda c: c) if r % 2 == 0 else (lambda c, r=r: F.xxhash64(F.lit(r), c))
        both = left.unionByName(left.select(b.alias("a"), a.alias("b")))
        if isinstance(left.schema["a"].dataType, LongType):
            best = both.groupBy("a").agg(F.min("b").alias("m") if r % 2 == 0 else F.min_by("b", order(b)).alias("m"))
            up = F.when(order(F.col("m")) < order(a), F.col("m")).otherwise(a)
        else:
            best = both.groupBy("a").agg(F.min(F.struct(order(b).alias("o"), b.alias("b"))).alias("m"))
            up = F.least(F.struct(order(a).alias("o"), a.alias("b")), F.col("m"))["b"]
        parent = materialize(best.select(a.alias("node"), up.alias("up")), "parents")
        parents.append(parent)
        pa_, pb_ = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = left.join(pa_, "a").join(pb_, "b").where("ua <> ub")
        left = materialize(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if not parents:
        return left.select(a.alias("node"), b.alias("component"))
    roots = parents[-1]
    for parent in reversed(parents[:-1]):
        above = roots.select(F.col("node").alias("up"), F.col("up").alias("top"))
        roots = parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    roots = materialize(roots, "roots")
    least = roots.groupBy("up").agg(F.min("node").alias("component"))
    return roots.join(least, "up").select("node", "component")
