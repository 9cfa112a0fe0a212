import random
import zlib

import numpy as np

from statutum.llm import toxicity as op
from statutum.llm.queries import op5_toxicity

from .helpers import WORDS, prose


def made(rng, n=600):
    """Documents of which one in eight has words that only toxic ones have; labels for two thirds."""
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["badword", "nastyterm", "vileness"]))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, "s", -1.0) for i, t in docs], "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_it_finds_toxic_texts_that_it_was_not_shown(spark):
    docs, labels = made(random.Random(1))
    out = {r.doc_id: r for r in op.toxicity(*frames(spark, docs, labels)).collect()}
    assert len(out) == len(docs)
    held = [i for i in out if out[i].held_out]
    assert set(held) == {i for i in out if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [out[i].predicted == int(i % 8 == 0) for i in held]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())


def test_held_out_labels_change_nothing(spark):
    docs, labels = made(random.Random(2), 300)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = [{r.doc_id: r.score for r in op.toxicity(*frames(spark, docs, x)).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    docs, labels = made(random.Random(3), 200)
    docs += [(None, None), (900, None), (901, ""), (902, " \n"), (903, "badword " * 30_000), (5, docs[5][1])]
    labels += [(None, 1), (1, None), (5000, 1), (3, 0), (3, 1)]
    out = op.toxicity(*frames(spark, docs, labels)).collect()
    assert len(out) == len(docs) and all(r.source == "s" and r.score >= 0 for r in out)
    assert len({r.score for r in out if r.doc_id in (900, 901, 902)}) == 1
    assert len({r.score for r in out if r.doc_id == 5}) == 1 and next(r for r in out if r.doc_id is None).held_out is False


def test_without_labels_or_documents(spark):
    docs, labels = made(random.Random(4), 50)
    d, k = frames(spark, docs, labels)
    assert len({r.score for r in op.toxicity(d, k.limit(0)).collect()}) == 1 and op.toxicity(d.limit(0), k).count() == 0
    assert {r.predicted for r in op.toxicity(d, k.where("toxic = 0")).collect()} == {0}


def test_the_risk_stays_above_zero():
    """A part that would go negative steps back: scores of unlabelled positives do not collapse to 0."""
    rng = random.Random(5)
    positives = [f"badword {prose(rng, 10)}".encode() for _ in range(30)]
    unlabelled = [prose(rng, 10).encode() for _ in range(70)] + [f"badword {prose(rng, 10)}".encode() for _ in range(10)]
    names = sorted(set().union(*map(op.feature_set, positives + unlabelled)))
    numbers = lambda texts: [np.array([i for i, name in enumerate(names) if name in op.feature_set(t)]) for t in texts]
    score = op.fit(numbers(positives), numbers(unlabelled), names, 0.125).scorer()
    assert score([b"badword ba"])[0] > 0.5 > score([WORDS[0].encode()])[0]


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    tp = sum(r.predicted and r.toxic for r in out)
    assert tp / max(1, sum(r.predicted for r in out)) >= 0.8 and tp / max(1, sum(r.toxic for r in out)) >= 0.9


def test_positives_are_cut_in_order_of_the_hash(spark, monkeypatch):
    monkeypatch.setattr(op, "POSITIVES", 10)
    monkeypatch.setattr(op, "UNLABELLED", 20)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(80)] + [(7, "text 6")], "doc_id long, text string").repartition(3)
    labels = docs.selectExpr("doc_id", "1 as toxic")
    rows, prior = op.sample(docs, labels)
    for kind, seed, most in ((1, 11, 10), (0, 13, 20)):
        spread = docs.select("doc_id").distinct().selectExpr("doc_id", f"xxhash64({seed}, doc_id) as h").where(op.remainder() != op.HELD_OUT).orderBy("h").limit(most)
        want = {(r.doc_id, f"text {6 if r.doc_id == 7 else r.doc_id}".encode()) for r in spread.collect()}
        assert {(r.doc_id, bytes(r.text)) for r in rows.where(f"kind = {kind}").collect()} == want
    assert prior == 1


def test_features_are_counted_and_sent_by_executors(spark):
    """The features chosen, and those of each document, equal those of a count in one place; few or many, they arrive."""
    rng = random.Random(6)
    docs, labels = made(rng, 400)
    frame, known = frames(spark, docs, labels)
    rows, _ = op.sample(frame, known)
    local = [(r.kind, bytes(r.text)) for r in rows.collect()]
    n, m = sum(k for k, _ in local), sum(1 - k for k, _ in local)
    names = op.telling_features(rows, n, m)
    found = []
    for name in set().union(*(op.feature_set(t) for _, t in local)):
        a, b = sum(k == 1 and name in op.feature_set(t) for k, t in local), sum(k == 0 and name in op.feature_set(t) for k, t in local)
        share = (a + b) / (n + m)
        z = (a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-12)
        if a >= op.LEAST and z > op.SIGNIFICANCE:
            found.append((-z, name))
    assert names == [name for _, name in sorted(found)] and b"wbadword" in names
    every = sorted(set().union(*(op.feature_set(t) for _, t in local)))
    got = {(r.kind, r.doc_id): [every[i] for i in op._numbers(bytes(r.features))] for r in rows.mapInArrow(op._present(every), "kind int, place long, doc_id long, features binary").collect()}
    assert got == {(r.kind, r.doc_id): sorted(op.feature_set(bytes(r.text))) for r in rows.collect()}
