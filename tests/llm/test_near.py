import random

import numpy as np
import pytest

from statutum.llm import near_dedup as op
from statutum.llm.queries import op9_near_dedup

from .helpers import components, lower, prose, split


def shingles(text, n=3):
    w = split(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=3, num=85, den=100):
    ids = [i for i, _ in rows]
    sets = {i: shingles(t, n) for i, t in rows}
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                links.append((a, b))
    of = components(ids, links)
    return sorted((i, len(sets[i]), of[i], of[i] == i) for i in ids)


def edited(rng, text, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice("uno due tre".split())
    return " ".join(words)


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "ONE"), (6, "one two"), (7, "one  TWO"), (8, "one two three"), (9, "Ż x"), (10, "ż x")]
    for i in range(20, 140, 6):
        text = prose(rng, rng.randint(20, 300))
        rows.append((i, text))
        rows += [(i + k, edited(rng, text, rng.choice((0, 1, 2, 5, 9)))) for k in range(1, 6)]
    chain = prose(rng, 100).split()
    rows += [(200 + k, " ".join(chain[k * 3 : k * 3 + 60])) for k in range(12)]  # each like the next, ends unlike
    rows += [(300, "la " * 4000), (301, "LA " * 3000), (302, prose(rng, 20_000))]
    return rows


def got(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, name string, keys string").repartition(5)
    assert got(op.near_duplicates(docs)) == brute(rows)


def test_other_shingles_and_thresholds(spark):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(op.near_duplicates(docs, 5, 80, 100)) == brute(rows, 5, 80, 100)


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.8, 0.7, 0.5])
def test_layout_meets_pairs_at_the_threshold(threshold):
    """Few enough pairs are missed by the formula, and as few meet no table when drawn."""
    n, rows = op.layout(threshold)
    agree = threshold**rows
    assert (1 - agree) ** n + n * agree * (1 - agree) ** (n - 1) <= op.MISS
    rng, missed = np.random.default_rng(3), 0
    common, apart = round(100 * threshold), 100 - round(100 * threshold)
    for _ in range(300):
        both = rng.integers(0, 1 << 63, common).astype(np.uint64)
        keys = [op.table_keys(op.collection_keys(np.concatenate([both, rng.integers(0, 1 << 63, k).astype(np.uint64)]), n, rows)[None]) for k in (apart // 2, apart - apart // 2)]
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 1


def test_layouts():
    assert op.layout(0.85) == (16, 4)
    with pytest.raises(ValueError):
        op.layout(0.1)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 8)
    rng = random.Random(4)
    text = prose(rng, 200)
    rows = [(i, edited(rng, text, i % 4)) for i in range(150)] + [(1000 + i, text) for i in range(50)]
    assert got(op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_crowds_and_long_runs_are_linked_as_a_whole(spark, monkeypatch):
    """Small bounds, so that batches have crowds, runs are long and go over batches, and large families have members unlike their first."""
    for name, value in (("CROWD", 3), ("RUN", 4), ("BLOCK", 8)):
        monkeypatch.setattr(op, name, value)
    rng = random.Random(9)
    text = prose(rng, 150)
    rows = [(i, edited(rng, text, i % 30)) for i in range(200)] + [(1000 + i, prose(rng, 120) + " " + text) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(op.near_duplicates(docs)) == brute(rows)


def test_runs_link_by_sketch_and_over_batches():
    import pyarrow as pa

    rows = [(1, False, 10, 0), (2, False, 11, 0), (2, False, 12, -1), (2, False, 13, -2), (3, True, 14, 0), (3, False, 15, -1)] + [(4, False, 20 + i, -i * 7**15) for i in range(op.RUN + 50)] + [(5, False, 9000, 0), (5, False, 9001, 5)]
    for cut in ([len(rows)], [2, 3, 5, 40, 200, 300, len(rows)]):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a:b], strict=True)], ["key", "crowd", "doc_id", "sketch"]) for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        links = {(a, b) for out in op._run_links(5)(iter(batches)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)}
        assert links == {(13, 12), (15, 14), (9001, 9000)} | {(20 + i, 20) for i in range(1, op.RUN + 50)}


def test_sketches_keep_pairs_at_the_threshold():
    rng, limit, missed = np.random.default_rng(5), op.sketch_limit(0.85, op.SKETCH), 0
    for _ in range(1000):
        both = rng.integers(0, 1 << 63, 170).astype(np.uint64)
        a, b = (op.sketch(op.minhashes(np.concatenate([both, rng.integers(0, 1 << 63, 15).astype(np.uint64)]), 64)) for _ in range(2))
        missed += bin((a ^ b) % (1 << 64)).count("1") > limit
    assert missed == 0 and limit < 26


def test_long_sketches_keep_pairs_at_the_threshold():
    """Of pairs at 0.85 all are alike, of pairs at 0.4 hardly any; a row is not like itself."""
    rng, least = np.random.default_rng(6), op.equal_limit(0.85, op.SKETCH)

    def pair(both, own):
        common = rng.integers(0, 1 << 63, both).astype(np.uint64)
        return [np.frombuffer(op.long_sketch(op.minhashes(np.concatenate([common, rng.integers(0, 1 << 63, own).astype(np.uint64)]), 64)), np.uint8) for _ in range(2)]

    one, two = np.array([0]), np.array([1])
    like = lambda a, b: bool(op.alike(a[None], b[None], one, two, least)[0][0])
    assert all(like(*pair(170, 15)) for _ in range(1000)) and sum(like(*pair(80, 60)) for _ in range(2000)) < 20
    a = pair(10, 10)[0][None]
    assert not op.alike(a, a, one, one, least)[0].any()


def test_boilerplate_sends_texts_less_than_three_times(spark, monkeypatch):
    """Texts of similarity 0.4, which chance meetings put into one family of many blocks, and two that are copies: found, and others hardly read."""
    rng = random.Random(8)
    base = " ".join(rng.choice([f"w{k}" for k in range(900)]) for _ in range(120))
    rows = [(i, base + " " + " ".join(f"x{i}_{k}" for k in range(90))) for i in range(6000)]
    rows += [(7000, rows[4000][1].replace("x4000_5", "other")), (7001, rows[50][1] + " tail")]
    stored, real = {}, op.materialize

    def kept(df, name):
        stored[name] = real(df, name)
        return stored[name]

    monkeypatch.setattr(op, "BLOCK", 64)
    monkeypatch.setattr(op, "materialize", kept)
    out = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted((r.doc_id, r.component_id) for r in out.where("not kept").collect()) == [(7000, 4000), (7001, 50)]
    assert stored["families"].count() > 1000 and stored["families"].count() + stored["meetings"].count() < 3 * len(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x y z")]
    out = [tuple(r) for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out, key=str) == sorted([(None, 2, None, True)] * 2 + [(1, 2, 1, True)] * 2 + [(2, 1, 2, True)], key=str)


def test_no_documents(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_by_incidence():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(40) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 45 * len(np.union1d(sets[i], sets[j]))}
    a, b = op.linked_pairs(sets, 0, 45, 100)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and want
    a, b = op.linked_pairs(sets, 15, 45, 100)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i, j in want if i < 15 <= j}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op9_near_dedup(spark, sf_dir)) == brute(rows)
