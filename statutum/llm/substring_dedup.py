"""Substring dedup: long word windows that occur more than once are cut out of every text.

Super-k-mer partitioning. Consecutive windows of a document that share a minimiser (the least of the short word
runs inside a window) travel to that minimiser's bucket as one packed string, so a window's text is shipped about three
times rather than ``WINDOW`` times. Equal windows have equal minimisers, hence meet in one bucket, where sorting counts
them exactly. Runs of words that a hashed share of the documents shows to draw many windows come last in the order of runs, behind
all others, so that a phrase in every document is no minimiser where a window has any other run; windows of nothing
but such runs go by the least and the greatest of their runs together. Equal windows agree on both, and no bucket holds
all windows around one phrase. Each map batch sends equal strings once, so what a frequent passage sends is bounded by the number of
batches and not by its copies. Buckets return, for the identity of each packed string, which of its windows repeat; the
documents' own list of (identity, position) is joined with that, which Spark may split where a string is very common.

Null and empty texts have no words and keep none. Equal rows repeat each other. Words are maximal runs of characters
other than U+0020 and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, groups, mix, ngram_hashes, row_name, shuffle_partitions

WINDOW = 35
#: Words in the runs whose least is the minimiser; windows in a packed string at most; bytes of strings in a bucket, about.
MINIMISER, LONGEST, BUCKET_BYTES = 4, 256, 4 << 20
#: One document in so many is looked at for heavy minimisers; words that make one heavy there; heavy ones that are kept, at most.
LOOKED_AT, HEAVY_WORDS, HEAVY = 32, 4000, 1 << 16
#: Bytes of text for each shuffle partition, about.
PARTITION_BYTES = 32 << 20


def _sliding(values: np.ndarray, wide: int, pick) -> np.ndarray:
    """``pick`` (least or greatest) of every ``wide`` neighbours."""
    span = 1
    while span < wide:
        step = min(span, wide - span)
        values = pick(values[:-step], values[step:])
        span += step
    return values


def super_kmers(words: np.ndarray, window: int = WINDOW, m: int = MINIMISER, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and minimisers of the super-k-mers of one document's hashed words; ``heavy`` ascending."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    runs, last = ngram_hashes(words, m) >> np.uint64(1), np.uint64(1 << 63)
    if heavy is not None and len(heavy):
        runs = np.where(heavy[np.minimum(np.searchsorted(heavy, runs), len(heavy) - 1)] == runs, runs | last, runs)
    least = _sliding(runs, window - m + 1, np.minimum)
    if least.max() >= last:
        least = np.where(least >= last, mix(least ^ mix(_sliding(runs, window - m + 1, np.maximum))), least)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    ends = np.append(starts[1:], n)
    if (ends - starts).max() > LONGEST:
        starts = np.concatenate([np.arange(s, e, LONGEST) for s, e in zip(starts, ends, strict=True)])
        ends = np.append(starts[1:], n)
    return starts, ends - starts, least[starts]


def packed_strings(text: bytes | None, hashes: WordHashes, window: int, heavy: np.ndarray) -> tuple[list[bytes], list[int], np.ndarray]:
    """The super-k-mers of a text as strings of words, where they start, and their minimisers."""
    words = text.split() if text else []
    if len(words) < window:
        return [], [], np.empty(0, np.uint64)
    starts, counts, minis = super_kmers(hashes.of(words), window, heavy=heavy)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # behind the space that follows each word
    first = np.concatenate(([0], ends))[starts].tolist()
    last = (ends[starts + counts + window - 2] - 1).tolist()
    return [whole[a:b] for a, b in zip(first, last, strict=True)], starts.tolist(), minis


def _weigh(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words_at: dict[int, int] = {}
            for text in batch.column("text").to_pylist():
                _, counts, minis = super_kmers(hashes.of(text.split() if text else []), window)
                for mini, count in zip(minis.view(np.int64).tolist(), counts.tolist(), strict=True):
                    words_at[mini] = words_at.get(mini, 0) + count + window - 1
            yield pa.RecordBatch.from_pydict({"mini": pa.array(list(words_at), pa.int64()), "words": pa.array(list(words_at.values()), pa.int64())})

    return run


def heavy_minimisers(raw: DataFrame, window: int = WINDOW) -> np.ndarray:
    """The minimisers of most words, ascending: at most ``HEAVY`` of them, found in a hashed share of the documents. No result depends on them."""
    some = raw.where(F.pmod(F.xxhash64(F.lit(3), "row_key"), F.lit(LOOKED_AT)) == 0).select("text")
    weighed = some.mapInArrow(_weigh(window), "mini long, words long").groupBy("mini").agg(F.sum("words").alias("words")).where(F.col("words") >= HEAVY_WORDS)
    return np.sort(np.array([r[0] for r in weighed.orderBy(F.col("words").desc(), "mini").limit(HEAVY).select("mini").collect()], np.int64).view(np.uint64))


def _pack(buckets: int, window: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, press = WordHashes(), zstandard.ZstdCompressor(level=5)
        for batch in batches:
            seen: dict[bytes, int] = {}
            for text in batch.column("text").to_pylist():
                strings, _, minis = packed_strings(text, hashes, window, heavy)
                for packed, bucket in zip(strings, (minis % np.uint64(buckets)).tolist(), strict=True):
                    seen[packed] = -1 - bucket if packed in seen else bucket
            by: dict[int, list[bytes]] = {}
            for packed, bucket in seen.items():
                twice = bucket < 0
                by.setdefault(-1 - bucket if twice else bucket, []).append((b"2" if twice else b"1") + packed)
            if by:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(by, pa.int64()), "blob": pa.array([press.compress(b"\n".join(x)) for x in by.values()], pa.binary())})

    return run


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def repeated_windows(ids: np.ndarray, starts: np.ndarray, always: np.ndarray, window: int) -> np.ndarray:
    """Which windows ``ids[start:start + window]`` occur at more than one start, or are marked ``always``.

    Windows are sorted by a polynomial hash; neighbours in that order are compared word by word, and where unequal
    windows share a hash those are sorted by their words.
    """
    out = always.copy()
    if len(starts) < 2:
        return out
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        powers = np.cumprod(np.full(len(ids), base, np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers)))
        back = np.cumprod(np.full(len(ids), inverse, np.uint64))
        hashed = (sums[starts + window] - sums[starts]) * back[starts]
    order = np.argsort(hashed, kind="stable")
    hashed = hashed[order]
    same = np.flatnonzero(hashed[1:] == hashed[:-1])
    spans = np.lib.stride_tricks.sliding_window_view(ids, window)
    clash: set[int] = set()
    for at in range(0, len(same), 20_000):
        part = same[at : at + 20_000]
        left, right = order[part], order[part + 1]
        equal = (spans[starts[left]] == spans[starts[right]]).all(axis=1)
        out[left[equal]] = out[right[equal]] = True
        clash.update(hashed[part[~equal]].tolist())
    for value in clash:  # unequal windows under one hash
        by: dict[bytes, list[int]] = {}
        for i in order[np.searchsorted(hashed, np.uint64(value), "left") : np.searchsorted(hashed, np.uint64(value), "right")].tolist():
            by.setdefault(spans[starts[i]].tobytes(), []).append(i)
        for members in by.values():
            if len(members) > 1:
                out[members] = True
    return out


def _count(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for _, rows in groups(batches, ["bucket"]):
            number, seen, numbers, flat, sizes, flags = _Numbers(), {}, [], [], [], []
            for blob in rows.column("blob"):
                for marked in press.decompress(blob.as_py()).split(b"\n"):
                    packed = marked[1:]
                    key = xxhash.xxh3_128_digest(packed)
                    at = seen.get(key)
                    if at is not None:
                        flags[at] = True
                        continue
                    seen[key] = len(sizes)
                    words = packed.split(b" ")
                    flat += words
                    sizes.append(len(words))
                    flags.append(marked[:1] == b"2")
                numbers.append(np.fromiter(map(number.__getitem__, flat), np.int32, len(flat)))
                flat.clear()
            sizes = np.array(sizes)
            counts = sizes - window + 1
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            edges = np.concatenate(([0], np.cumsum(counts)))
            starts = np.repeat(first - edges[:-1], counts) + np.arange(edges[-1])
            hit = repeated_windows(np.concatenate(numbers), starts, np.repeat(np.array(flags), counts), window)
            some = np.flatnonzero(np.add.reduceat(hit, edges[:-1])).tolist()
            if some:
                names = list(seen)
                yield pa.RecordBatch.from_pydict(
                    {
                        "packed_id": pa.array([names[i] for i in some], pa.binary()),
                        "mask": pa.array([np.packbits(hit[edges[i] : edges[i + 1]]).tobytes() for i in some], pa.binary()),
                    }
                )

    return run


def _places(window: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, ids, at = [], [], []
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                strings, starts, _ = packed_strings(text, hashes, window, heavy)
                keys += [key] * len(starts)
                ids += map(xxhash.xxh3_128_digest, strings)
                at += starts
            yield pa.RecordBatch.from_pydict({"row_key": pa.array(keys, pa.binary()), "packed_id": pa.array(ids, pa.binary()), "start": pa.array(at, pa.int32())})

    return run


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed each by itself, which takes a third less of the shuffle than its own compression."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [None if x is None else press.compress(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(texts, pa.binary())], ["doc_id", "row_key", "text"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            total, removed, kept = [], [], []
            for text, masks in zip(batch.column("text").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                words = press.decompress(text).split() if text is not None else []
                cover = np.zeros(len(words) + 1, np.int32)
                for one in masks or ():
                    hit = np.flatnonzero(np.unpackbits(np.frombuffer(one["mask"], np.uint8))) + one["start"]
                    np.add.at(cover, hit, 1)
                    np.subtract.at(cover, hit + window, 1)
                keep = np.cumsum(cover)[:-1] == 0
                total.append(len(words))
                removed.append(int(len(words) - keep.sum()))
                kept.append(b" ".join(words) if keep.all() else b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k))
            arrays = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("text", "masks")]
            names = [name for name in batch.schema.names if name not in ("text", "masks")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row of ``docs(doc_id, text)``, other columns ignored.

    A word goes if any window of ``window`` words over it also starts anywhere else in ``docs``, judged on the input.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"), row_name().alias("row_key"))
    raw = docs.select("text", "row_key")
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), text_bytes // PARTITION_BYTES)
    buckets = max(parts, 3 * text_bytes // BUCKET_BYTES)
    heavy = heavy_minimisers(raw, window)
    packed = raw.select("text").mapInArrow(_pack(buckets, window, heavy), "bucket long, blob binary")
    repeated = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(window), "packed_id binary, mask binary")
    masks = raw.mapInArrow(_places(window, heavy), "row_key binary, packed_id binary, start int").join(repeated, "packed_id").groupBy("row_key").agg(F.collect_set(F.struct("start", "mask")).alias("masks"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.mapInArrow(_press, f"doc_id {id_type}, row_key binary, text binary")
    joined = texts.join(masks, "row_key", "left").select("doc_id", "text", "masks")
    cut = joined.mapInArrow(_cut(window), f"doc_id {id_type}, n_words long, n_removed long, kept binary")
    return cut.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
