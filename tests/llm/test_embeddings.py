import math
import random

import numpy as np
import pytest

from statutum.llm import embedding_dedup as op
from statutum.llm.queries import op3_embedding_dedup

from .helpers import components


def brute(rows, threshold=0.95):
    sound = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {k: v / np.abs(v).max() for k, v in sound.items()}
    unit = {k: v / np.sqrt((v * v).sum()) for k, v in unit.items()}
    nodes, links, count = sorted(unit), [], dict.fromkeys(unit, 0)
    for n, a in enumerate(nodes):
        for b in nodes[n + 1 :]:
            if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    of, least = components(nodes, links), {}
    for k in nodes:
        least[of[k]] = min(least.get(of[k], rows[k][0]), rows[k][0])
    named = [least[of[k]] if k in of else i for k, (i, _) in enumerate(rows)]
    return sorted(((i, count.get(k, 0), named[k], i == named[k]) for k, (i, _) in enumerate(rows)), key=str)


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[int(rng.integers(0, len(rows)))][1])
            rows.append((i, (base + rng.normal(0, 0.08, dim)).tolist()))
        else:
            rows.append((i, rng.normal(0, 1, dim).tolist()))
    return rows


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_equals_brute_force_with_odd_rows(spark):
    rows = vectors(3)
    one = rows[5][1]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [float("inf")] + [1.0] * 15), (906, [x * 1e300 for x in one]), (907, [x * 1e-300 for x in one]), (908, one), (909, one), (910, one[:4]), (911, one[:4]), (7, one), (7, one), (7, rows[9][1]), (None, one)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, vector string, members int").repartition(4)
    assert got(op.near_vectors(frame)) == brute(rows)


def test_large_groups_of_copies_are_counted(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)  # cuts buckets into blocks
    rng = random.Random(1)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 1e-3) for x in base] if i % 2 else base) for i in range(300)]
    assert got(op.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_single_precision_and_many_tables(spark):
    """Floats stay floats on their way; more rows give longer codes and more tables."""
    rows = [(i, np.float32(v).tolist()) for i, v in vectors(5, 3000, 24)]
    assert got(op.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6))) == brute(rows)


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    limit, missed = op.sketch_limit(), 0
    for _ in range(2000):
        a, b = rng.normal(size=32), rng.normal(size=32)
        a /= np.sqrt(a @ a)
        b -= (a @ b) * a
        pair = np.stack([a, 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.sqrt(b @ b)])
        signs = pair @ rng.normal(size=(32, op.SKETCH)) >= 0
        missed += (signs[0] != signs[1]).sum() > limit
    assert missed == 0 and limit < op.SKETCH // 3


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    frame = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>").limit(n)
    assert got(op.near_vectors(frame)) == [(5, 0, 5, True)][:n]


def test_tables_suffice():
    for n in (10, 10_000, 10**9, 10**12):
        bits, tables = op.shape(n)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - meet) ** tables <= op.MISS and bits <= op.CODE_BITS and tables < 1 << op.TABLE_BITS


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(op3_embedding_dedup(spark, sf_dir)) == brute(rows)
