"""Digests of a stream are those of the batch asked at every full hour, over changes of clocks."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from statutum.functions import dates
from statutum.streaming import alerts as live
from statutum.streaming import digests

from .test_streaming import run

UTC = timezone.utc
ZONES = ("Europe/Warsaw", "Asia/Kolkata", "America/New_York")


@pytest.mark.parametrize("night", [datetime(2026, 3, 28, tzinfo=UTC), datetime(2026, 10, 24, tzinfo=UTC), datetime(2026, 11, 1, tzinfo=UTC)])
def test_boundaries_are_those_of_the_batch(spark, night):
    """The batch's boundary at the next one is that one, and just before it none after the instant asked about."""
    rng = random.Random(night.month)
    rows = []
    for _ in range(300):
        mode, zone, hour, day = rng.choice(("hourly", "daily", "weekly")), rng.choice(ZONES), rng.randrange(24), rng.randint(1, 7)
        after = night + timedelta(seconds=rng.randrange(2 * 86400)) if rng.random() < 0.8 else night + timedelta(hours=rng.randrange(48))
        at = digests.next_boundary(mode, ZoneInfo(zone), hour, day, after)
        rows.append((mode, zone, hour, day, after.replace(tzinfo=None), at.replace(tzinfo=None), (at - timedelta(microseconds=1)).replace(tzinfo=None)))
    frame = spark.createDataFrame(rows, "mode string, zone string, h int, d int, after timestamp, at timestamp, before timestamp")
    boundary = lambda c: dates.digest_boundary(F.col("mode"), F.col("zone"), F.col("h"), F.col("d"), F.col(c))
    wrong = frame.where((boundary("at") != F.col("at")) | (boundary("before") > F.col("after")))
    assert [tuple(r) for r in wrong.collect()] == []


def asked_hourly(spark, rows, wishes, until):
    """What goes out when the batch's rule is asked at every full hour; its boundaries and quiet hours come from the batch's functions."""
    start = min(r[3] for r in rows).replace(minute=0, second=0, microsecond=0)
    hours = [(o, *w, start + timedelta(minutes=30 * k)) for o, w in wishes.items() for k in range(int((until - start) / timedelta(minutes=30)) + 2)]
    frame = spark.createDataFrame(hours, "o string, mode string, zone string, h int, d int, qf int, qt int, now timestamp")
    frame = frame.where(F.minute(F.from_utc_timestamp("now", F.col("zone"))) == 0)
    found = frame.select("o", "now", dates.digest_boundary(F.col("mode"), F.col("zone"), F.col("h"), F.col("d"), F.col("now")).alias("b"), dates.is_quiet(F.col("qf"), F.col("qt"), F.col("zone"), F.col("now")).alias("q")).collect()
    asks = defaultdict(list)
    for r in found:
        asks[r.o].append((r.now, r.b, r.q))
    out = set()
    for o, (mode, zone, _, _, qf, qt) in wishes.items():
        line = sorted([(r[3], 0, r) for r in rows if r[1] == o] + [(now, 1, (b, q)) for now, b, q in asks[o]], key=lambda x: (x[0], x[1], str(x[2])))
        waiting, last = [], None
        for at, kind, what in line:
            if kind == 0:
                still = digests.quiet(qf, qt, ZoneInfo(zone), at.replace(tzinfo=UTC))
                if what[2] == "critical" or mode == "immediate" and not still:
                    out.add((o, at, what[0]))
                    last = at
                else:
                    waiting.append(what)
            elif waiting:
                b, q = what
                if (mode == "immediate" or b > (last or min(w[3] for w in waiting))) and not q:
                    out |= {(o, at, w[0]) for w in waiting}
                    waiting, last = [], at
    return out


@pytest.mark.parametrize(("night", "batches"), [(datetime(2026, 3, 27), 5), (datetime(2026, 10, 23), 3)])
def test_stream_equals_the_batch(spark, tmp_path, night, batches):
    live.use_rocksdb(spark)
    rng = random.Random(batches)
    wishes = {f"o{k}": (mode, rng.choice(ZONES), rng.randrange(24), rng.randint(1, 7), *quiet) for k, (mode, quiet) in enumerate((m, q) for m in ("hourly", "daily", "weekly", "immediate") for q in ((None, None), (22, 7), (1, 5)))}
    end = night + timedelta(days=12)
    rows = [(f"n{i}", f"o{rng.randrange(len(wishes))}", "critical" if rng.random() < 0.1 else "normal", night + timedelta(seconds=rng.randrange(3 * 86400))) for i in range(260)]
    last = [(f"z{o}", o, "critical", end) for o in wishes]  # moves the watermark over all that waits
    schema = "notification_id string, owner_id string, urgency string, created_at timestamp, mode string, zone string, at_hour int, on_weekday int, quiet_from int, quiet_to int"
    ordered = sorted(rows, key=lambda r: r[3])
    cuts = [ordered[k * len(rows) // batches : (k + 1) * len(rows) // batches] for k in range(batches)] + [last]
    for part in cuts:
        rng.shuffle(part)
        spark.createDataFrame([(*r, *wishes[r[1]]) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(digests.digest_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")))
    got = [(r.owner_id, r.closed_at, r.notification_id) for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    limit = end - timedelta(minutes=15)
    want = {w for w in asked_hourly(spark, rows, wishes, end) if w[1] <= limit}
    assert len(got) == len(set(got)) and {g for g in got if g[2][0] == "n"} == want and len(want) > 200
