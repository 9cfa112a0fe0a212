"""Token ids of documents in sorted-string-table shards.

A shard is one file of entries in ascending key order. A key is a document's id as 8 big-endian bytes with the sign flipped
(so that bytes order as numbers; a null id is an empty key and comes first), then 4 bytes that count equal ids. An entry holds
the length it shares with the key before it, the rest of the key, and the ids as unsigned 16- or 32-bit little-endian
numbers. About ``BLOCK_BYTES`` of entries make a block, compressed by itself and starting with a whole key. After the blocks
come a sparse index (first key, offset, length and entries of each block), a Bloom filter of the ids and a footer of fixed size
with their places, the entry and id counts and a magic number. A look-up reads the footer, asks the Bloom filter, bisects the
index and opens one block. Shards hold disjoint ranges of ids; a list of them with their first and last keys finds the
shard. A task begins a new shard when one has ``SHARD_BYTES``, never between equal ids. Documents of equal ids follow each other in order of
their texts, so any layout of the input gives the same ids in the same places.

Texts are encoded whole with the ``tokenizers`` library. Before a space that a non-space follows, byte-level BPE always
starts a new pre-token, so a text is cut there and each distinct piece is encoded once and remembered (a bounded number of
them); texts where spaces meet other white space are encoded as they are. A null or empty text has the end id alone. A very long text is one entry, encoded and
read in one task, in a block of its own if it exceeds one. Other columns are ignored, whatever their names. An empty table gives no shard and no rows.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, materialize, shared_path, shuffle_partitions, write_file

END_ID = 0
#: Bytes of ids in a block, about; bits of the Bloom filter for each entry; hashes in it; pieces remembered in a process.
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES, REMEMBERED = 256 << 10, 10, 7, 250_000
#: Bytes of a shard, about.
SHARD_BYTES = 512 << 20
MAGIC = b"STATSST1"
#: A space that no non-space follows: there a text is not cut.
_ODD = re.compile(r" (?:\s|$)")
FOOTER = struct.Struct("<QQQQQQI4x8s")  # index at, index bytes, Bloom at, Bloom bytes, entries, ids, bytes of an id, magic


class Encoder:
    """Ids of whole texts as bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose token starts with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.special = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, pieces: list[str], into: dict[str, bytes]) -> None:
        """Encode pieces, none of which holds a space or starts with white space, each with a space before it."""
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):  # does not happen for pieces as described; then one by one
                into.update((p, self.whole(" " + p)) for p in part)
                continue
            raw, edges = ids.tobytes(), [*(starts * self.width).tolist(), len(ids) * self.width]
            into.update((p, raw[a:b]) for p, a, b in zip(part, edges[:-1], edges[1:], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = []
        cut: list[str] = []
        sizes: list[int] = []
        for text in texts:
            text = text or ""
            if _ODD.search(text) or any(s in text for s in self.special):
                out.append(self.whole(text))
                sizes.append(-1)
                continue
            head, *parts = text.split(" ")
            out.append(self.whole(head) if head else b"")
            cut += parts
            sizes.append(len(parts))
        found = list(map(self.pieces.get, cut))
        if None in found:
            fresh: dict[str, bytes] = {}
            self.learn(list({p for p, f in zip(cut, found, strict=True) if f is None}), fresh)
            if len(self.pieces) < REMEMBERED:
                self.pieces.update(fresh)
            found = [fresh[p] if f is None else f for p, f in zip(cut, found, strict=True)]
        at = 0
        for i, n in enumerate(sizes):
            if n > 0:
                out[i] += b"".join(found[at : at + n])
                at += n
        return out


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if len(key) == 4 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


def _places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    return [((h >> 64) + i * (h & ((1 << 64) - 1))) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """The bytes of a shard, from entries in ascending order of keys."""

    def __init__(self, width: int):
        self.width, self.at, self.entries, self.ids = width, 0, 0, 0
        self.index: list[bytes] = []
        self.keys: set[bytes] = set()
        self.last, self.count, self.block, self.first, self.held = b"", 0, [], b"", 0
        self.press = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        base = key_of(doc_id)
        self.count = self.count + 1 if self.entries and self.last[:-4] == base else 0
        key = base + struct.pack(">I", self.count)
        if self.held >= BLOCK_BYTES:
            yield from self.flush()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block.append(struct.pack("<BBI", shared, len(key) - shared, len(ids)) + key[shared:] + ids)
        self.held += len(ids)
        self.entries += 1
        self.ids += len(ids) // self.width
        self.keys.add(base)
        self.last = key

    def flush(self) -> Iterator[bytes]:
        if self.block:
            data = self.press.compress(b"".join(self.block))
            self.index.append(struct.pack("<BQII", len(self.first), self.at, len(data), len(self.block)) + self.first)
            self.at += len(data)
            self.block, self.held = [], 0
            yield data

    def close(self) -> Iterator[bytes]:
        yield from self.flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros((bits + 7) // 8 * 8, bool)
        for key in self.keys:
            bloom[_places(key, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        yield index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.entries, self.ids, self.width, MAGIC)


class Shard:
    """A shard opened for look-ups and scans; reads its footer, index and filter at once."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.source = system.open_input_file(path)
        size = self.source.size()
        self.source.seek(size - FOOTER.size)
        index_at, index_bytes, bloom_at, bloom_bytes, self.entries, self.ids, self.width, magic = FOOTER.unpack(self.source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.source.seek(index_at)
        raw, self.blocks, at = self.source.read(index_bytes), [], 0
        while at < len(raw):
            n, offset, length, count = struct.unpack_from("<BQII", raw, at)
            at += struct.calcsize("<BQII")
            self.blocks.append((raw[at : at + n], offset, length, count))
            at += n
        self.source.seek(bloom_at)
        packed = self.source.read(bloom_bytes)
        self.bits = struct.unpack_from("<Q", packed)[0]
        self.bloom = packed[8:]
        self.inflate = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, count = self.blocks[k]
        self.source.seek(offset)
        data, at, last = self.inflate.decompress(self.source.read(length)), 0, b""
        for _ in range(count):
            shared, rest, size = struct.unpack_from("<BBI", data, at)
            at += 6
            last = last[:shared] + data[at : at + rest]
            at += rest
            yield last, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document under an id, none if it is absent."""
        if not self.may_hold(doc_id):
            return []
        base, out = key_of(doc_id), []
        k = max(0, bisect.bisect_right([b[0] for b in self.blocks], base) - 1)
        while k < len(self.blocks) and (self.blocks[k][0][: len(base)] <= base):
            out += [np.frombuffer(v, "<u2" if self.width == 2 else "<u4") for key, v in self.block(k) if key[:-4] == base]
            k += 1
        return out

    def close(self) -> None:
        self.source.close()


def write_tables(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards in ascending order of ids; a stored list of them.

    Its columns: ``shard, file, entries, ids, first_id, last_id``. Ranges are cut by sampled ids with equal numbers of rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    by_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    by_id = by_id.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        entries = (e for batch in batches for e in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True))
        task, part, entry = TaskContext.get().partitionId(), 0, next(entries, None)

        def chunks(writer: Writer, ends: list) -> Iterator[bytes]:
            """A shard of the entries from the next one on; leaves the first that it does not take."""
            nonlocal entry
            while entry is not None:
                doc_id, raw = entry
                if ends and writer.at >= SHARD_BYTES and doc_id != ends[-1]:
                    break
                yield from writer.add(doc_id, raw + end)
                ends[:] = [*ends[:1], doc_id]
                entry = next(entries, None)
            yield from writer.close()

        while entry is not None:
            writer, ends, name = Writer(encoder.width), [], f"{folder}/shard-{task:06d}-{part:04d}.sst"
            write_file(name, chunks(writer, ends))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([(task << 20) + part], pa.int64()), "file": [name], "entries": pa.array([writer.entries], pa.int64()), "ids": pa.array([writer.ids], pa.int64()), "first_id": pa.array(ends[:1], pa.int64()), "last_id": pa.array(ends[-1:], pa.int64())})
            part += 1

    return materialize(by_id.mapInArrow(run, "shard long, file string, entries long, ids long, first_id long, last_id long"), "shards")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each Python process; what it remembers helps later tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read_tables(spark: SparkSession, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every entry of the shards: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``token_ids``.

    ``start`` counts the ids of all entries before it, over shards in their order. Sums over shards go to the driver, one
    row for each file.
    """
    total, starts = 0, []
    for row in shards.select("shard", "file", "ids").orderBy("shard").collect():
        starts.append((row.file, total))
        total += row.ids
    listed = spark.createDataFrame(starts, "file string, before long")
    listed = listed.repartition(max(1, min(len(starts), 10 * spark.sparkContext.defaultParallelism)), "file")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("token_ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard, rows, at, held = Shard(file), [], start, 0
                for key, raw in shard.scan():
                    ids = np.frombuffer(raw, "<u2" if shard.width == 2 else "<u4").astype("<u4")
                    rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
                    at += len(ids)
                    held += len(ids)
                    if len(rows) >= 5000 or with_ids and held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)
                        rows, held = [], 0
                shard.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids)


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back."""
    spark = docs.sparkSession
    return read_tables(spark, write_tables(docs, shared_path(spark, "tokens"), tokenizer, end_id))
