"""Kept tables rewrite what a write changes and nothing else; kept medians equal those from scratch."""

import os
import random

from pyspark.sql import functions as F

from statutum.operators import legislative, stored, writes

KIND = "k long, name string, at long"


def folders(root):
    return {f"{v}/{b}" for v in os.listdir(f"{root}/data") for b in os.listdir(f"{root}/data/{v}") if b.startswith("bucket=")}


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    table = stored.Table(spark, root, KIND, ("k",), 16)
    assert table.read().count() == 0 and table.version() == 0
    first = [(k, f"n{k}", k) for k in range(400)]
    table.upsert(spark.createDataFrame(first, KIND), "at")
    assert table.version() == 1 and rows(table.read()) == sorted(first, key=str) and len(folders(root)) == 16
    change = [(7, "new", 1000), (8, "old", 1), (9999, "more", 5)]  # one newer, one older than what is stored, one more
    written = table.upsert(spark.createDataFrame(change, KIND), "at")
    want = sorted([r for r in first if r[0] != 7] + [change[0], change[2]], key=str)
    assert rows(table.read()) == want and 1 <= len(written) <= 2 and {f for f in folders(root) if f.startswith("v=2")} == {f"v=2/bucket={b}" for b in written}
    assert table.upsert(spark.createDataFrame(change, KIND), "at") == [] and table.version() == 2  # again: nothing
    before = table.read()
    table.upsert(spark.createDataFrame([(7, "third", 2000)], KIND), "at")
    assert before.where("k = 7").first()["name"] == "new"  # a reader of the version before
    for n in range(3):
        table.upsert(spark.createDataFrame([(7, f"v{n}", 3000 + n)], KIND), "at")
    assert len(folders(root)) <= 16 + 3 and table.read().where("k = 7").first()["name"] == "v2"
    assert rows(table.read().where("k <> 7")) == [r for r in want if r[0] != 7]


def test_null_keys_and_rows_taken_out(spark, tmp_path):
    table = stored.Table(spark, str(tmp_path / "t"), KIND, ("k",), 4)
    table.write(spark.createDataFrame([(None, "a", 1), (1, "b", 1)], KIND), lambda held, new: held.unionByName(new))
    table.upsert(spark.createDataFrame([(2, "c", 1)], KIND), "at")
    assert rows(table.read()) == [(1, "b", 1), (2, "c", 1), (None, "a", 1)]
    table.write(table.read(), lambda held, new: held.limit(0))
    assert table.read().count() == 0 and table.version() == 3
    table.upsert(spark.createDataFrame([(5, "d", 1)], KIND), "at")
    assert rows(table.read()) == [(5, "d", 1)]


def test_upserts_in_batches_equal_one(spark, tmp_path):
    rng = random.Random(3)
    every = [(rng.randrange(50), rng.choice("abc"), t) for t in range(300)]
    table = stored.Table(spark, str(tmp_path / "t"), KIND, ("k",), 8)
    for k in range(3):
        table.upsert(spark.createDataFrame(every[k * 100 : k * 100 + 100], KIND), "at")
    assert rows(table.read()) == rows(writes.latest(spark.createDataFrame(every, KIND), ["k"], "at"))


def test_kept_medians_equal_those_from_scratch(spark, tmp_path):
    """Ten batches, some of which restate stays of earlier ones."""
    rng = random.Random(5)
    kind = "initiator string, stage string, seconds long"
    kept, live = stored.stay_lengths(spark, str(tmp_path / "t"), 4), []
    for batch in range(10):
        new = [(rng.choice(("r", "p", None)), rng.choice("st"), 86400 * rng.randint(1, 9)) for _ in range(15)]
        gone = [live.pop(rng.randrange(len(live))) for _ in range(4)] if batch % 3 == 2 else []
        new += [(i, s, x + 86400) for i, s, x in gone]
        live += new
        stored.add_stays(kept, spark.createDataFrame(new, kind), spark.createDataFrame(gone, kind) if gone else None)
    key = lambda f: rows(f.select("initiator", "overall", "stage", "median_seconds", "n"))
    assert key(stored.kept_paces(kept)) == key(legislative.stage_paces(spark.createDataFrame(live, kind)))
    assert kept.read().agg(F.sum("k")).first()[0] == len(live) and kept.read().where("k <= 0").count() == 0


def test_asks_by_bins_equal_plain(spark):
    """Random intervals, open ones and ones of many bins, asked on days before, inside and behind them."""
    from datetime import datetime, timedelta

    rng, start = random.Random(7), datetime(2026, 1, 1)
    at = lambda n: start + timedelta(hours=rng.randrange(24), days=n)
    held = []
    for d in range(6):
        for _ in range(15):
            a = rng.randrange(300)
            held.append((d, f"s{rng.randrange(5)}", at(a), None if rng.random() < 0.2 else at(a + rng.randrange(1, 200)), at(a + rng.randrange(30))))
    asks = [(i, rng.randrange(8), at(rng.randrange(-20, 400)), at(rng.randrange(400))) for i in range(200)]
    got = legislative.as_of_asks(spark.createDataFrame(held, "draft_id int, stage string, valid_from timestamp, valid_to timestamp, known_at timestamp"), spark.createDataFrame(asks, "ask int, draft_id int, day timestamp, known timestamp"), days=7)
    want = [(i, d, day, known, s, f) for i, d, day, known in asks for e, s, f, t, k in held if e == d and f <= day and (t is None or t > day) and k <= known]
    assert rows(got) == sorted(want, key=str) and len(want) > 100
    assert legislative.as_of_asks(got.sparkSession.createDataFrame(held, "draft_id int, stage string, valid_from timestamp, valid_to timestamp, known_at timestamp"), spark.createDataFrame([], "ask int, draft_id int, day timestamp, known timestamp")).count() == 0
