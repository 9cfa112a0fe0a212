"""Requests are paced for each host, and waits before a retry are spread but repeatable."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from statutum.functions import fetching


def test_paced_equals_one_by_one(spark):
    rng, start = random.Random(2), datetime(2026, 1, 1)
    rows = [(rng.choice(("a", "b", None)), i, start + timedelta(seconds=rng.choice((0, rng.randrange(400)))), 0.0) for i in range(200)]
    rows = [(h, i, at, {"a": 0.2, "b": 2.0}.get(h, 1.0)) for h, i, at, _ in rows]
    want, last = {}, {}
    for h, i, at, rate in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        want[i] = at if h is None or h not in last else max(at, last[h] + timedelta(seconds=1 / rate))
        last[h] = want[i]
    got = fetching.paced(spark.createDataFrame(rows, "host string, request int, asked_at timestamp, per_second double"))
    assert {r.request: r.sent_at for r in got.collect()} == want


def test_waits_are_spread_and_repeatable(spark):
    tries = spark.range(600).select((F.col("id") % 3 + 1).cast("int").alias("t"), F.concat(F.lit("r"), F.col("id")).alias("r"))
    waits = [tries.select("t", fetching.jittered_wait(F.col("t"), F.col("r")).alias("w")).collect() for _ in range(2)]
    assert waits[0] == waits[1]
    for t in (1, 2, 3):
        w = [r.w for r in waits[0] if r.t == t]
        assert min(w) >= 2 ** (t - 1) and max(w) < 1.5 * 2 ** (t - 1) and len(set(w)) > 190
