import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from statutum.llm import mixing as op
from statutum.llm.queries import op10_mixing

from .helpers import prose, split


def targets(sizes):
    """By hand: share what is left by weight, fix what is above its bound, again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, out):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(split(text))
    want = targets(sizes)
    assert len(out) == len(rows)
    taken, largest = {}, {}
    for r in out:
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest[s], 1e-6)
    return want


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 9) for i, t, s in rows], "doc_id long, text string, source string, size int")


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", "ż", "Z", None])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, " \n", "nowords"), (None, "x y", "a"), (None, "x y", "a"), (7, rows[7][1], rows[7][2]), (6000, "w " * 30_000, "huge")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_are_met(spark, seed):
    rows = rows_of(seed)
    want = check(rows, op.mix(frame(spark, rows)).collect())
    assert want["nowords"] == 0


def test_reruns_and_other_partitions_agree(spark):
    rows = rows_of(4)
    a, b = (sorted(map(str, op.mix(frame(spark, rows).repartition(n)).select("doc_id", "source", "size", "taken").collect())) for n in (1, 7))
    assert a == b


def test_one_source_and_none(spark):
    rows = [(i, "a b c", None) for i in range(100)]
    out = op.mix(frame(spark, rows)).collect()
    check(rows, out)
    assert sum(r.taken for r in out) == 450
    assert op.mix(frame(spark, [])).count() == 0


def test_inclusion_grows_with_size(spark):
    """Rank by random odds over inclusion odds: larger documents are taken more often, all have a chance."""
    rng = random.Random(5)
    rows = [(i, prose(rng, 4 if i % 2 else 64), "a" if i % 5 else "b") for i in range(4000)]
    out = [r for r in op.mix(frame(spark, rows)).collect() if r.source == "b"]
    share = {n: np.mean([r.taken > r.size * min(x.taken // x.size for x in out) for r in out if r.size == n]) for n in (4, 64)}
    assert 0 < share[4] < share[64]


def pareto(rows, u):
    """What each (id, size, source) row takes, by hand: whole copies, certain ones, then in order of the ranks until the words are reached."""
    words = {}
    for _, size, source in rows:
        words[source] = words.get(source, 0) + size
    want, taken = targets(words), {}
    for source in words:
        of = [(i, size) for i, size, s in rows if s == source]
        whole = int(want[source] / words[source] + 1e-12) if words[source] else 0
        rest, certain = want[source] - whole * words[source], set()
        while True:
            open_ = [(i, z) for i, z in of if z and i not in certain]
            weight = sum(z**1.5 for _, z in open_)
            left = rest - sum(z for i, z in of if i in certain)
            sure = {i for i, z in open_ if left * z**0.5 >= weight * (1 - 1e-9) and z == max(y for _, y in open_)}
            if rest <= 0 or not sure:
                break
            certain |= sure
        copies = {i: whole + (i in certain) for i, _ in of}
        if rest > 0:
            p = {i: left * z**0.5 / weight for i, z in open_}
            filled = 0
            for i, z in sorted(open_, key=lambda x: (math.log(u[x[0]] / (1 - u[x[0]])) - math.log(p[x[0]] / (1 - p[x[0]])), x[0])):
                if filled + z <= left or filled < left and abs(filled + z - left) <= abs(filled - left):
                    copies[i] += 1
                filled += z
        taken |= {i: copies[i] * z for i, z in of}
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_sample_equals_pareto_sampling_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 2, 5, 20, 60]), rng.choice("aab")) for i in range(500)] + [(500 + i, 1500 + i, "b") for i in range(3)] + [(600 + i, 3, "c") for i in range(40)] + [(700, 4000, "c"), (701, 0, "c")]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string").repartition(4)
    hashes = docs.select("doc_id", F.xxhash64(F.lit(op.SEED), "doc_id").alias("h")).collect()
    u = {r.doc_id: (r.h % (1 << 52) + 0.5) / (1 << 52) for r in hashes}
    out = op.mix(docs).collect()
    assert {r.doc_id: r.taken for r in out} == pareto(rows, u)
    assert any(r.size > 1000 and r.taken > 0 for r in out)


def test_certain_documents_are_taken(spark):
    """A document larger than its even share of what is to be sampled has no chance to be left out."""
    for seed in range(6):
        rows = [(1000 * seed + i, "w " * 3, "b") for i in range(200)] + [(1000 * seed + 900, "w " * 900, "b")] + [(1000 * seed + 950 + i, "w " * 100, "a") for i in range(21)]
        b = [r for r in op.mix(frame(spark, rows)).collect() if r.source == "b"]
        assert b[0].target == 1350 and next(r for r in b if r.size == 900).copies == 1 and {r.copies for r in b} == {0, 1}


def test_null_ids_are_spread(spark):
    rows = [(None, f"w{i} " * 3, "b") for i in range(300)] + [(i, "a " * 5, "a") for i in range(300)]
    out = [r for r in op.mix(frame(spark, rows)).collect() if r.source == "b"]
    assert len({r.copies for r in out}) == 2 or out[0].target in (out[0].source_size, 2 * out[0].source_size)
    check(rows, op.mix(frame(spark, rows)).collect())


def test_sizes(spark):
    texts = ["a b", "a b", " a\t\n\x0b\x0c\r b ", "a\x1cb", "", None, "ż 🙂"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(op.size_of(F.col("t")).alias("n")).collect()]
    assert got == [len(split(t)) for t in texts]


def test_query_and_native_plan(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    source = {i: s for i, _, s in rows}
    frame_ = op10_mixing(spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", frame_._jdf.queryExecution().toString())

    class Row:
        def __init__(self, r):
            self.size, self.source_size, self.target, self.taken, self.source = r.size, r.source_size, r.target, r.taken, source[r.doc_id]

    check(rows, [Row(r) for r in frame_.collect()])
