import hashlib
import random
import re

import pytest

from statutum.llm import decontamination as op
from statutum.llm.queries import op4_decontamination

from .helpers import lower, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(item) if item is not None else "")
    sizes = sorted({len(g) for g in grams})
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := grams.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc_id, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta, gamma-delta! Epsilon zeta eta theta iota kappa lambda mu nu xi omicron."), (2, "Krótkie pytanie?"), (3, None), (4, ""), (5, "..."), (6, "krótkie PYTANIE"), (None, "samo"), (10, "two words")]


def test_equals_brute_force(spark):
    rng = random.Random(2)
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = [(1, None), (2, ""), (3, long), (4, "x " * 400 + long.upper().replace(" ", " -- ")), (5, long.rsplit(" ", 3)[0]), (6, "Krótkie   pytanie krótkie pytanie"), (7, "krótkie xpytanie"), (8, "two words two words"), (8, "samo"), (None, "samo ż"), (9, prose(rng, 20_000) + " two words " + prose(rng, 10))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, contamination string").repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = op.contamination(frame, items)
    rows = [(r.doc_id, r.contamination) for r in got.collect()]
    assert sorted(((i, c.n_words, c.n_hit, list(c["items"]), c.contaminated) for i, c in rows), key=str) == brute(docs, ITEMS)
    texts = {(i, t) for i, t in docs}
    for r in got.where("contamination.n_hit > 0").collect():
        for s in r.contamination.spans:
            assert (r.doc_id, r.text) in texts and WORD.findall(lower(r.text[s.start : s.end])) and not r.text[s.start : s.end].startswith(" ")
    five = next(c for i, c in rows if i == 4)
    assert len(five.spans) == 1


def test_overlapping_windows_and_ends(spark):
    items = spark.createDataFrame([(1, "a b a"), (2, "b a b a b")], "item_id int, text string")
    docs = [(1, "a b a b a b"), (2, "b a b"), (3, "a b a")]
    got = {r.doc_id: (r.contamination.n_hit, list(r.contamination["items"])) for r in op.contamination(spark.createDataFrame(docs, "doc_id int, text string"), items).collect()}
    assert got == {i: (h, n) for i, _, h, n, _ in brute(docs, [(1, "a b a"), (2, "b a b a b")])}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert op.contamination(docs, items.limit(0)).first().contamination.n_hit == 0 and op.contamination(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("most", [1, 3, 8])
def test_large_sets_are_taken_in_parts(spark, monkeypatch, most):
    """Several automata, words hit by any of them counted once, columns of any name kept."""
    monkeypatch.setattr(op, "MOST_WINDOWS", most)
    rng = random.Random(7)
    items = [*ITEMS, *((20 + i, prose(rng, rng.randint(1, 18))) for i in range(8))]
    docs = [(i, " ".join([prose(rng, 15), items[8 + i % 8][1], prose(rng, 3), items[8 + (i + 3) % 8][1]])) for i in range(20)] + [(90, None), (91, ""), (92, "Krótkie pytanie two words samo")]
    frame = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, contamination int, `odd``name, x` double")
    out = op.contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "odd`name, x", "contamination"]
    rows = [(r.doc_id, r.contamination) for r in out.collect()]
    assert sorted(((i, c.n_words, c.n_hit, list(c["items"]), c.contaminated) for i, c in rows), key=str) == brute(docs, items)
    monkeypatch.setattr(op, "MOST_WINDOWS", 10_000)
    whole = op.contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, out.collect()))


def test_query(spark, sf_dir):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).collect()]
    want = sorted(((i, n, h, len(k), hashlib.sha256(",".join(k).encode()).hexdigest(), c) for i, n, h, k, c in brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))), key=str)
    assert sorted((tuple(r) for r in op4_decontamination(spark, sf_dir).collect()), key=str) == want
