"""Toxicity scores by non-negative positive-unlabelled learning.

Labels are learned from only where crc32 of the id as text leaves a remainder other than ``HELD_OUT`` by 4. Confirmed toxic
documents are the positives; the others, whatever their label, are a sample of unlabelled text. Labels of 0 only enter the
class prior, the share of toxic among labelled documents. A linear classifier on presences of words and word beginnings
minimises the risk estimate ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``, the second part
being what negatives would contribute; where it falls below 0 the step goes back along it. With the logistic loss
the score estimates the probability of label 1.

The fit reads at most ``POSITIVES`` and ``UNLABELLED`` documents, chosen by a hash of the id, whole. Executors count their features, choose
those that tell the two apart, and send the driver the chosen features of each document, at most ``FEATURES`` bits for one;
no text leaves the executors. Every text is scored whole. Null and empty texts get the score of a text without features. Rows with a null id are scored and count as not held
out, but are not learned from; labels that are null, or of absent documents, are ignored; a document labelled more than once
is positive if any label is 1; of documents with one id, the smallest text is learned from. Without positives or without documents every score is the prior. Equal rows have equal
scores. Other columns stay; ``held_out``, ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import bounded_batches, map_rows, materialize

HELD_OUT, THRESHOLD = 2, 0.3
#: Documents that the fit reads at most; features at most; least positives with a feature; significance of a feature.
POSITIVES, UNLABELLED, FEATURES, LEAST, SIGNIFICANCE = 2500, 7500, 40_000, 5, 6.0
#: Letters of word beginnings; steps, step size and weight decay of the fit; words remembered in a process.
BEGINNINGS, STEPS, RATE, DECAY, REMEMBERED = (3, 4, 5, 6, 7, 8), 400, 0.1, 3e-3, 300_000

_EDGE = b".,;:!?\"'()[]{}<>|*$%&#-_/\\=+~`"


def features_of(word: bytes) -> list[bytes]:
    """Names of a lower-cased word's features: itself, and its beginnings where it is longer."""
    text = word.strip(_EDGE).decode("utf-8", "replace")
    if not text:
        return []
    return [b"w" + text.encode()] + [b"p" + text[:n].encode() for n in BEGINNINGS if len(text) > n]


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    prior: float

    def scorer(self):
        """A function from texts to scores; remembers the features of a bounded number of words."""
        names = list(self.weights)
        number = {name: i for i, name in enumerate(names)}
        weight = np.array([self.weights[n] for n in names] + [0.0])

        class Words(dict):
            def __missing__(words, word):  # noqa: N805
                found = tuple(i for f in features_of(word) if (i := number.get(f)) is not None)
                if len(words) < REMEMBERED:
                    words[word] = found
                return found

        words = Words()

        def score(texts: list[bytes | None]) -> np.ndarray:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                found = set().union(*map(words.__getitem__, set(text.lower().split()))) if text else ()
                out[i] = self.bias + (weight[list(found)].sum() if found else 0.0)
            return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

        return score


def feature_set(text: bytes) -> set[bytes]:
    return {f for w in set(text.lower().split()) for f in features_of(w)}


def _together(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each document's features, and the features of all."""
    return np.cumsum([0, *map(len, rows)]), np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)


def _product(at: np.ndarray, index: np.ndarray, w: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(w[index])))
    return sums[at[1:]] - sums[at[:-1]]


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], names: list[bytes], prior: float) -> Model:
    """Train on documents given as ascending numbers of their features."""
    prior = min(max(prior, 1e-4), 0.9)
    n, m, size = len(positives), len(unlabelled), len(names)
    if not n or not m:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    pos, unl = _together(positives), _together(unlabelled)
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)

    def gradient(part, slope):
        at, index = part
        return np.append(np.bincount(index, np.repeat(slope, np.diff(at)), size), slope.sum())

    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, STEPS + 1):
        fp, fu = _product(*pos, w) + bias, _product(*unl, w) + bias
        sp, su = sigmoid(fp), sigmoid(fu)
        negative_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        as_negative = gradient(unl, su / m) - prior * gradient(pos, sp / n)
        g = prior * gradient(pos, (sp - 1) / n) + as_negative if negative_risk >= 0 else -as_negative
        g[:size] += DECAY * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:size], bias - move[size]
    return Model({name: float(w[i]) for i, name in enumerate(names)}, float(bias), prior)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """The documents to learn from, ``kind, place, doc_id, text``, kind 1 being positives, stored; and the share of positives among labels."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(remainder() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    # twice as many as wanted: labels may name documents that are not there
    places = {kind: F.xxhash64(F.lit(seed), "doc_id") for kind, seed in ((1, 11), (0, 13))}
    positive = known.where("toxic = 1").orderBy(places[1], "doc_id").limit(2 * POSITIVES).select("doc_id", F.lit(1).alias("kind"), places[1].alias("place"))
    other = docs.select("doc_id").where("doc_id is not null").where(remainder() != HELD_OUT).groupBy("doc_id").agg(F.lit(1)).orderBy(places[0], "doc_id").limit(UNLABELLED)
    chosen = materialize(positive.unionByName(other.select("doc_id", F.lit(0).alias("kind"), places[0].alias("place"))), "chosen")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("kind", "place", "doc_id").agg(F.min("text").alias("text"))
    rows = materialize(rows, "sample")
    here = [r[0] for r in rows.where("kind = 1").select("place").orderBy("place").limit(POSITIVES + 1).collect()]
    return (rows.where((F.col("kind") == 0) | (F.col("place") < here[-1])) if len(here) > POSITIVES else rows), prior or 0.01


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True):
            count[kind].update(feature_set(text))
        names = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.binary()), "a": pa.array([count[1][x] for x in names], pa.int64()), "b": pa.array([count[0][x] for x in names], pa.int64())})


def telling_features(rows: DataFrame, n: int, m: int) -> list[bytes]:
    """The features of n positives and m unlabelled documents whose shares differ most, in that order."""
    counted = rows.select("kind", "text").mapInArrow(_count_features, "name binary, a long, b long").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / F.lit(n + m)
    z = (F.col("a") / F.lit(n) - F.col("b") / F.lit(m)) / F.sqrt(share * (1 - share) * F.lit(1 / n + 1 / m) + F.lit(1e-12))
    chosen = counted.where(F.col("a") >= LEAST).select("name", z.alias("z")).where(F.col("z") > SIGNIFICANCE)
    return [bytes(r[0]) for r in chosen.orderBy(F.col("z").desc(), "name").limit(FEATURES).select("name").collect()]


def _present(names: list[bytes]):
    """Of each document the numbers of the chosen features that it has, or all as bits where that is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(names)}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = np.array(sorted(number[f] for f in feature_set(text) if f in number), np.uint16)
                bits = np.zeros(len(names), bool)
                bits[found] = True
                out.append(min(b"n" + found.tobytes(), b"b" + np.packbits(bits).tobytes(), key=len))
            yield pa.RecordBatch.from_pydict({"kind": batch.column("kind"), "place": batch.column("place"), "doc_id": batch.column("doc_id"), "features": pa.array(out, pa.binary())})

    return run


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed[1:], np.uint16) if packed[:1] == b"n" else np.flatnonzero(np.unpackbits(np.frombuffer(packed[1:], np.uint8)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample, whose features are counted and chosen on the executors."""
    rows, prior = sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    size = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    n, m = size.get(1, 0), size.get(0, 0)
    if not n or not m:
        return fit([], [], [], prior)
    names = telling_features(rows, n, m)
    sent = rows.mapInArrow(_present(names), "kind int, place long, doc_id long, features binary").collect()
    sent = sorted((r.kind, r.place, r.doc_id, bytes(r.features)) for r in sent)
    return fit([_numbers(x) for k, _, _, x in sent if k == 1], [_numbers(x) for k, _, _, x in sent if k == 0], names, prior)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with ``held_out, score, predicted``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(docs, labels)))
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(pickle.loads(shared.value).scorer())
        for batch in batches:
            scores = made[0](batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    scored = map_rows(docs.drop("held_out", "score", "predicted"), run, [StructField("score", DoubleType())], "doc_id", "text")
    held = F.coalesce(remainder() == HELD_OUT, F.lit(False))
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= THRESHOLD).cast("int")})
