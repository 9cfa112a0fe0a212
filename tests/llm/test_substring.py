import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from statutum.llm import substring_dedup as op
from statutum.llm.queries import op1_substring_dedup

from .helpers import prose, split


def brute(rows, window):
    count = Counter(tuple(w[i : i + window]) for w in (split(t) for _, t in rows) for i in range(len(w) - window + 1))
    out = []
    for doc_id, text in rows:
        w = split(text)
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def rows_of(rng):
    shared = [prose(rng, n) for n in (35, 50, 120)]
    rows = [(0, None), (1, ""), (2, "  \t\n "), (3, prose(rng, 34)), (3, prose(rng, 40))]
    for i in range(10, 60):
        parts = [prose(rng, rng.randint(1, 60)) for _ in range(3)]
        if i % 2:
            parts.insert(1, shared[i % 3])
        rows.append((i, " ".join(parts)))
    rows += [(70, "x " * 500), (71, "Ża ba c " * 40 + "\x1c\x85"), (72, rows[20][1]), (72, rows[20][1]), (None, rows[21][1]), (80, prose(rng, 9000))]
    return rows


@pytest.mark.parametrize("window", [5, 35])
def test_equals_brute_force(spark, window):
    rows = rows_of(random.Random(window))
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, row_key string, n_words int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in op.substring_dedup(docs, window).collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table(spark):
    assert op.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_super_kmers_hold_every_window_once():
    words = np.random.default_rng(1).integers(0, 50, 5000, dtype=np.uint64)
    starts, counts, minis = op.super_kmers(words, 35)
    assert counts.sum() == 5000 - 34 and (starts[1:] == starts[:-1] + counts[:-1]).all() and counts.max() <= op.LONGEST
    again, _, same = op.super_kmers(words[starts[3] : starts[3] + 34 + counts[3]], 35)
    assert same[0] == minis[3] and again[0] == 0
    flat, per, _ = op.super_kmers(np.zeros(3000, np.uint64), 35)  # one word over and over: long runs are cut
    assert per.sum() == 2966 and per.max() <= op.LONGEST and len(flat) > 1


def test_a_phrase_in_every_document_fills_no_bucket(spark, monkeypatch):
    """A run of words that is all documents' least would draw every window around it; known to be heavy, it comes last."""
    rng = random.Random(3)
    hashes = op.WordHashes()
    phrase = min((prose(rng, 4) for _ in range(3000)), key=lambda p: int(op.ngram_hashes(hashes.of(p.encode().split()), 4)[0]))
    texts = [f"{prose(rng, 60)} {phrase} {prose(rng, 60)} {phrase} {prose(rng, 40)}" for _ in range(200)] + [f"{phrase} " * 60] * 3
    fullest = lambda heavy: max(Counter(m for t in texts[:200] for _, c, minis in [op.super_kmers(hashes.of(t.encode().split()), 35, heavy=heavy)] for m, n in zip(minis.tolist(), c.tolist(), strict=True) for _ in range(n)).values())
    monkeypatch.setattr(op, "LOOKED_AT", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    heavy = op.heavy_minimisers(docs.select("text", op.row_name().alias("row_key")).selectExpr("cast(text as binary) as text", "row_key"))
    assert len(heavy) >= 1 and fullest(None) > 10_000 > 2000 > fullest(heavy)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in op.substring_dedup(docs).collect()), key=str)
    assert got == brute(list(enumerate(texts)), 35)


@pytest.mark.parametrize("window", [5, 35])
def test_heavy_minimisers_change_no_result(spark, monkeypatch, window):
    monkeypatch.setattr(op, "LOOKED_AT", 1)
    monkeypatch.setattr(op, "HEAVY_WORDS", 1)
    rows = rows_of(random.Random(window + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in op.substring_dedup(docs, window).collect()), key=str) == brute(rows, window)


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(op, "mix", lambda x: np.zeros_like(x))
    ids = np.array([1, 2, 3, 4, 1, 2, 9, 9, 3, 4])
    starts = np.arange(0, 9)
    assert op.repeated_windows(ids, starts, np.zeros(9, bool), 2).tolist() == [True, False, True, False, True, False, False, False, True]


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows, 35)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, sf_dir).collect()} == want
