"""Importance resampling of a corpus towards a target distribution: array-scored weights, sorted runs, tournament trees.

Both the corpus and the target are bags of hashed n-grams: counts of ``buckets`` buckets each, taken over all texts. The log ratio of the two
smoothed multinomials is an array of integer gains (thousandths), and a document's weight is the floored mean of the gains of its features. A draw
without replacement by these weights is the top of weight plus Gumbel noise, and the noise comes from a hash of the id, so reruns agree.

1. A task counts the features of its texts in one array; arrays are summed by bucket. The driver receives ``buckets`` numbers of each side.
2. A second reading scores every text by the array of gains. Rows of a partition are sorted by score and written: a run, on shared storage.
3. Counts by score, of which there are at most some ten thousand however many rows there are, say which score the draw ends at, and the rank that every
   score begins with. Scores are cut into spans of nearly equal numbers of rows. Runs are read from their tops only down to the last
   score; a span takes its slice of each run, and a tournament tree merges the slices and gives out ranks until the draw is exact. Spans are merged
   apart from each other, each at its known first rank, so nothing goes through one task. A span has at most ``SPAN`` rows or one score,
   which has some four in ten thousand of the rows at most, as the noise spreads equal weights.

Null and empty texts have no features and weigh 0. Equal scores go to the smaller id, null before others; rows with equal ids and scores take their ranks in any
order, and a third of all rows with one id meet in one span. Equal rows are drawn each. Ids may be of any type that sorts. Very long texts are read whole, one at a time. An
empty table gives no rows, an empty target flat counts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shuffle_partitions
from .decontamination import words_of

#: Longest n-gram, buckets, drawn share in a hundred, fewest words of a document to draw, seed of the noise.
GRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Rows of a span that one tree merges, at most, but for rows of one score.
SPAN = 100_000
#: Words whose buckets a worker remembers.
REMEMBERED = 300_000


class _Buckets(dict):
    """Buckets of single words."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) % self.buckets
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def features_of(words: list[bytes], known: _Buckets, grams: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``grams`` words, repeats counted."""
    single = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    longer = [np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) % known.buckets for i in range(len(words) - n + 1)), np.int64) for n in range(2, grams + 1)]
    return np.concatenate([single, *longer]) if longer else single


def bucket_counts(docs: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """Features in each bucket, over all texts of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts += np.bincount(features_of(words_of(text), known, grams), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": counts[some]})

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in found.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratios of the smoothed multinomials, in thousandths, floored."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(seed: int, name: str) -> int:
    """Gumbel noise of an id, in thousandths, floored."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, grams: int, least_words: int, seed: int) -> DataFrame:
    """``doc_id, n_features, weight, score, eligible`` of every row."""
    array = gains.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = _Buckets(len(gains)), np.frombuffer(array, np.int64)
        for batch in batches:
            n, weight, eligible = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = features_of(words, known, grams)
                n.append(len(found))
                weight.append(int(gain[found].sum()) // len(found) if len(found) else 0)
                eligible.append(len(words) >= least_words)
            score = [w + noise(seed, name or "") for w, name in zip(weight, batch.column("name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array(score, pa.int64()), pa.array(eligible)], ["doc_id", "n_features", "weight", "score", "eligible"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_features long, weight long, score long, eligible boolean")


def tournament(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: every node of the tree holds the run that won below it, and only the winner's path is played again."""
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    heads = [next(r, None) for r in runs] + [None] * (leaves - len(runs))

    def winner(i: int, j: int) -> int:
        return i if heads[j] is None or heads[i] is not None and heads[i] <= heads[j] else j

    tree = [0] * leaves + list(range(leaves))
    for k in range(leaves - 1, 0, -1):
        tree[k] = winner(tree[2 * k], tree[2 * k + 1])
    while True:
        best = tree[1] if leaves > 1 else 0
        if heads[best] is None:
            return
        yield heads[best]
        heads[best] = next(runs[best], None)
        k = (leaves + best) // 2
        while k:
            tree[k] = winner(tree[2 * k], tree[2 * k + 1])
            k //= 2


def spans_of(counts: dict[int, int], draw: int, most: int) -> tuple[int | None, list[tuple[int, int, int]]]:
    """The last score drawn, and ``score, span, first rank of the span`` for it and all above."""
    out: list[tuple[int, int, int]] = []
    above, span, begun = 0, 0, 0
    for score in sorted(counts, reverse=True):
        if above >= draw:
            break
        if above > begun and above + counts[score] - begun > most:
            span, begun = span + 1, above
        out.append((score, span, begun + 1))
        above += counts[score]
    return (out[-1][0] if out else None), out


def _merge(draw: int):
    """Ranks of spans whose rows come by run, each run in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, first, runs, last, ids, place = None, 0, [], None, [], 0

        def ranked() -> pa.RecordBatch:
            rows = tournament([iter(r) for r in runs])
            order, ranks = [], []
            for rank, row in enumerate(rows, first):
                order.append(row[-1])
                ranks.append(rank if rank <= draw else None)
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in pa.Table.from_batches(ids).take(pa.array(order)).columns), pa.array(ranks, pa.int64())], [*kept, "rank"])

        kept = ("doc_id", "n_features", "weight", "score")
        for batch in batches:
            start = 0
            spans, firsts, parts, scores, names = (batch.column(c).to_pylist() for c in ("span", "first", "run", "score", "doc_id"))
            for i, (s, f, r, score, name) in enumerate(zip(spans, firsts, parts, scores, names, strict=True)):
                if s != span:
                    if span is not None:
                        ids.append(batch.slice(start, i - start).select(kept))
                        yield ranked()
                    span, first, runs, last, ids, place, start = s, f, [], None, [], 0, i
                if r != last:
                    runs.append([])
                    last = r
                runs[-1].append((-score, name is not None, name, place))
                place += 1
            if span is not None:
                ids.append(batch.slice(start).select(kept))
        if span is not None:
            yield ranked()

    return run


def importance_resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs(doc_id, text)``; ranks are null where a row is not drawn.

    ``target(text)`` has the texts whose distribution is wanted. Of the N rows of at least ``least_words`` words, floor(percent * N / 100) are drawn.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shuffle_partitions(spark)
    gains = gains_of(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    runs = scored(docs, gains, grams, least_words, seed).withColumn("run", F.spark_partition_id())
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    runs = materialize(runs.sortWithinPartitions(F.desc("eligible"), *order), "runs")
    counts = {r["score"]: r["count"] for r in runs.where("eligible").groupBy("score").count().collect()}
    draw = percent * sum(counts.values()) // 100
    last, spans = spans_of(counts, draw, max(1, min(SPAN, -(-draw // parts))))
    none = F.lit(None).cast("long").alias("rank")
    kept = ("doc_id", "n_features", "weight", "score")
    if last is None:
        return runs.select(*kept, none)
    placed = F.broadcast(spark.createDataFrame(spans, "score long, span int, first long"))  # a row for each score, some ten thousand
    top = runs.where("eligible").where(F.col("score") >= last).join(placed, "score")
    slices = top.select(*kept, "run", "span", "first").repartition(parts, "span").sortWithinPartitions("span", "run", *order)
    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = slices.mapInArrow(_merge(draw), f"doc_id {kind}, n_features long, weight long, score long, rank long")
    rest = runs.where(~F.col("eligible") | (F.col("score") < last)).select(*kept, none)
    return rest.unionByName(drawn)


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with its best rank as ``rank``; rows without an id are left out."""
    best = ranked.where("rank is not null").groupBy(F.col("doc_id").alias("drawn_id_")).agg(F.min("rank").alias("rank_"))
    joined = docs.drop("rank").join(best, docs["doc_id"] == F.col("drawn_id_")).drop("drawn_id_")
    return joined.withColumnRenamed("rank_", "rank")
