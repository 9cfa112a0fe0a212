import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statutum.llm import resampling as op
from statutum.llm.queries import op11_importance_resampling

from .helpers import lower, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, buckets, percent, least):
    """Everything by hand: (id, features, weight, score) and the ids drawn, in order."""
    words = [WORD.findall(lower(t)) for _, t in docs]
    place = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(place(w) for ws in words for w in ws), Counter(place(w) for x in target for w in WORD.findall(lower(x)))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for (i, _), ws in zip(docs, words):
        weight = sum(gain(place(w)) for w in ws) // len(ws) if ws else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return rows, [r[0] for r in able[: percent * len(able) // 100]]


def corpus(seed, n):
    rng = random.Random(seed)
    docs = [(i, prose(rng, rng.choice((0, 3, 19, 20, 21, 60)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " .,; "), (n + 3, "Ząb ĄB €uro " * 10), (n + 4, prose(rng, 120_000)), (n + 5, docs[5][1])], [prose(rng, 40) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize(("percent", "span"), [(10, 100_000), (50, 7), (100, 1), (0, 100_000)])
def test_equals_plain(spark, monkeypatch, percent, span):
    monkeypatch.setattr(op, "SPAN", span)
    docs, target = corpus(percent, 300)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(9)
    got = op.importance_resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), buckets=97, percent=percent).collect()
    rows, drawn = plain(docs, target, 97, percent, 20)
    assert sorted(tuple(r)[:4] for r in got) == sorted(rows)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_ties_repeats_and_null_ids(spark):
    """Equal ids have equal scores: each row is drawn, ranks follow each other; null ids come before others of their score."""
    text = "ab cd " * 20
    docs = [(None, text)] * 5 + [(7, text)] * 30 + [(i, text) for i in range(100, 140)]
    got = op.importance_resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([("ab",)], "text string"), percent=60).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert len(got) == 75 and [r["rank"] for r in ranked] == list(range(1, 46))
    assert [r.score for r in ranked] == sorted((r.score for r in got), reverse=True)[:45]


def test_empty_tables_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(f"d{i}", "one two three " * 10) for i in range(20)], "doc_id string, text string")
    assert op.importance_resample(none, some).count() == 0
    got = op.importance_resample(some, none.select("text")).collect()
    assert len(got) == 20 and sum(r["rank"] is not None for r in got) == 2
    assert op.drawn_documents(some, op.importance_resample(some, none.select("text"))).select("text", "rank").count() == 2


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 64])
def test_tournament(runs):
    rng = random.Random(runs)
    made = [sorted((rng.randrange(50), k) for _ in range(rng.randrange(30))) for k in range(runs)]
    assert list(op.tournament([iter(r) for r in made])) == sorted(x for r in made for x in r)


def test_spans():
    """The last score that the draw reaches; spans of at most so many rows or one score; first ranks."""
    assert op.spans_of({5: 3, 4: 2, 1: 10, -2: 1}, 6, 4) == (1, [(5, 0, 1), (4, 1, 4), (1, 2, 6)])
    assert op.spans_of({5: 3, 4: 1}, 0, 4) == (None, []) and op.spans_of({}, 0, 1) == (None, [])


def test_longer_grams(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a")], "doc_id long, text string")
    assert {r.doc_id: r.n_features for r in op.importance_resample(docs, docs.select("text"), grams=2).collect()} == {1: 5, 2: 1}


def test_weights_move_the_draw(spark):
    """Documents with the target's words are drawn far more often than their share."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(("alpha", "beta", "gamma") if i % 10 == 0 else ("delta", "eps", "zeta")) for _ in range(30))) for i in range(2000)]
    got = op.importance_resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("alpha beta gamma " * 50,)], "text string"))
    drawn = [r.doc_id for r in got.where(F.col("rank").isNotNull()).collect()]
    assert len(drawn) == 200 and sum(i % 10 == 0 for i in drawn) > 150


def test_query_by_hand(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    rows, drawn = plain([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")], 10_000, 10, 20)
    got = op11_importance_resampling(spark, sf_dir).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(rows)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
