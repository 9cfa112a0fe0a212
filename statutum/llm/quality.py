"""Quality rules: plain counts of a text, and a log-likelihood ratio of hashed n-grams between trusted texts and the raw corpus.

The trusted texts (labelled of good quality) and the raw corpus (all texts) are each a multinomial over ``BUCKETS`` buckets of hashed runs of one
and two words. A text's score is the mean, over its features, of the log ratio of the two in floored thousandths: long and
short texts are measured alike. The raw multinomial is smoothed by one feature in each bucket; the trusted one by the raw one, as if ``BUCKETS`` more trusted features
were drawn from it, so that few trusted texts say little and none say nothing. The counts of the raw corpus are those of all other texts, a text's own being taken out, so that rare words of
a small corpus don't speak against the only text that has them. A text is kept if its score is not under ``THRESHOLD``; no chance takes part, and every
text is judged, in the task that reads it.

Counts are taken over all texts, and over all trusted texts; arrays of ``BUCKETS`` numbers are all that reaches the driver. Trusted texts are found by a join on
the id. So that not all texts travel for it, those whose id's hash has no bit among the ``SPREAD`` bits of trusted ids, a table of bounded size
that every task gets, are passed over where they are read; the join then decides about the others, by sorting whatever the sizes are.

Null and empty texts have counts of 0 and fail the base rules. Rows with null ids are judged, but never trusted. Rows with one id are trusted together, an id
labelled more than once counts once. Without trusted texts every ratio is 1 and base rules alone decide. Equal rows give equal rows. An empty
table gives no rows. Very long texts are read whole, one at a time. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Longest n-gram, buckets (a prime), multiplier of their hash, least mean ratio in thousandths.
GRAMS, BUCKETS, STEP, THRESHOLD = 2, 10_007, 65_599, -75
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000
#: Bits of the table that passes over texts without a trusted id, a power of two: 8 MB of masks at most.
SPREAD = 1 << 25
#: Base rules: fewest words; a text fails if more than so many words in a hundred are in windows found twice.
LEAST_WORDS, WINDOW, REPEATED = 50, 3, 50
SYMBOLS = b"#*$%&|<>"


class _Crc(dict):
    """Unsigned crc32 of words."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def features_of(words: list[bytes], known: _Crc, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of 1 to ``grams`` words: a run of n begins as n, and takes in a word as ``x * STEP + crc32`` modulo the buckets."""
    crc = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    out = []
    for n in range(1, min(grams, len(crc)) + 1):
        x = np.full(len(crc) - n + 1, n, np.int64)
        for k in range(n):
            x = (x * STEP + crc[k : len(crc) - n + 1 + k]) % buckets
        out.append(x)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more in the text."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    one = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    run = one
    for k in range(1, window):  # a run's number goes on with the next word; numbers stay below that of the runs
        run = np.unique(run[:-1] * len(numbers) + one[k:], return_inverse=True)[1]
    twice = np.bincount(run)[run] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    cover[at + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def characters(words: list[bytes]) -> int:
    """Code points in words."""
    return int(((np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80).sum())


def feature_counts(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Crc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts += np.bincount(features_of((text or b"").split(), known, grams, buckets), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": counts[some]})

    counts = np.zeros(buckets, np.int64)
    for row in docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def trusted_texts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``good(doc_id)``."""
    good = good.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).where("doc_id is not null").distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    masks = good.groupBy(F.shiftright(place, 6).alias("word_")).agg(F.bit_or(bit).alias("mask_"))
    near = docs.join(F.broadcast(masks), F.shiftright(place, 6) == F.col("word_")).where(F.col("mask_").bitwiseAND(bit) != 0)
    return near.select("doc_id", "text").join(good.hint("merge"), "doc_id")  # ids are distinct; a semi-join would be moved below the masks


def ratio_sum(features: np.ndarray, raw: np.ndarray, trusted: np.ndarray) -> int:
    """Sum over features of the floored log ratio in thousandths, the text's own features taken out of the raw counts."""
    bucket, own = np.unique(features, return_counts=True)
    rarity = (float(raw.sum() - len(features)) + len(raw)) / ((raw[bucket] - own).astype(float) + 1.0)
    ratio = (trusted[bucket] * rarity + len(raw)) / (float(trusted.sum()) + len(raw))
    return int((np.floor(1000 * np.log(ratio)).astype(np.int64) * own).sum())


def quality(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Counts and verdict for every row of ``docs(doc_id, text)``; ``labels(doc_id, quality)`` trusts those of quality 1.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``, the features ``n_features`` and their ``ratio_sum`` (thousandths), and ``kept``.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    raw, trusted = feature_counts(docs, grams, buckets), feature_counts(trusted_texts(docs, labels.where("quality = 1")), grams, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Crc()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or b""
                words = text.split()
                found = features_of(words, known, grams, buckets)
                total = ratio_sum(found, raw, trusted) if len(found) else 0
                repeats = repeated_words(words)
                failed = len(words) < LEAST_WORDS or 100 * repeats > REPEATED * len(words)
                symbols = len(text) - len(text.translate(None, SYMBOLS))
                rows.append((len(words), characters(words), symbols, repeated_lines(text), repeats, failed, len(found), total, not failed and total >= threshold * len(found)))
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.bool_() if k in (5, 8) else pa.int64()) for k in range(9))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_features", "ratio_sum", "kept"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'long'}" for n in names[1:]))
