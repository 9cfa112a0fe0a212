"""Pages are read once each, however a stream is cut or stopped."""

import json
import os
import time
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from statutum.sources import connector
from statutum.streaming import chain

from .test_streaming import run


def put(root, hour, source, chunk, address, payload, version=""):
    folder = root / hour / source / chunk
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{quote(address, safe='')}{version and '@' + version}.json").write_text(payload)


def landed(root, hours=4):
    want = []
    for h in range(hours):
        hour = f"2026-01-3{h % 2}T{h:02d}" if h % 2 == 0 else f"2026-01-30T{h:02d}"
        for source, chunk in (("sejm", "term10"), ("sejm", "term9"), ("isap", "DU-2024")):
            for n in range(5):
                address = f"{chunk.replace('-', '/')}/żółć {h}/{n}"
                put(root, hour, source, chunk, address, json.dumps({"h": h, "n": n}))
                want.append((source, chunk, address, hour))
    return sorted(want)


def rows(frame):
    return sorted((r.source, r.chunk, r.external_id, r.hour) for r in frame.collect())


def test_closed_hours_are_read(spark, tmp_path):
    want = landed(tmp_path)
    for hour in ("2026-01-30T00", "2026-01-30T01", "2026-01-30T03"):
        connector.close_hour(str(tmp_path), hour)
    put(tmp_path, "2026-01-30T00", "sejm", "term10", "_hidden", "x")
    first = [w for w in want if w[3] <= "2026-01-30T01"]
    assert rows(connector.read(spark, str(tmp_path))) == first  # hour 2 is open: what follows waits
    assert rows(connector.read(spark, f"file://{tmp_path}/", "isap")) == [w for w in first if w[0] == "isap"]
    connector.close_hour(str(tmp_path), "2026-01-30T02")
    assert rows(connector.read(spark, str(tmp_path))) == want
    contract = connector.CONTRACTS["sejm"]
    assert rows(contract.backfill(spark, str(tmp_path), "term9")) == [w for w in want if w[1] == "term9"]
    assert connector.read(spark, str(tmp_path)).where("chunk = 'term9'").select(contract.chunk(F.col("external_id")).alias("c")).distinct().first().c == "term9"
    assert connector.read(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("hours", [None, 1])
def test_a_stream_that_fails_loses_and_repeats_nothing(spark, tmp_path, hours):
    root, out, place = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    root.mkdir()
    want = landed(root)
    for hour in {w[3] for w in want}:
        connector.close_hour(str(root), hour)
    seen: list[int] = []

    def start(fail_at=None):
        def each(batch_rows, batch):
            chain.put_batch(batch_rows.drop("payload"), out, batch)
            seen.append(batch)
            if batch == fail_at:
                raise RuntimeError("killed between writing and commit")

        stream = connector.pages(spark, str(root), checkpoint=place, hours=hours)
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", place).start()

    query = start(fail_at=1 if hours else 0)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(90)
    late = put(root, "2026-01-31T09", "rcl", "list-1", "list/1/new", "{}")
    connector.close_hour(str(root), "2026-01-31T09")
    put(root, "2026-02-01T00", "rcl", "x", "open", "{}")  # stays open
    query = start()
    until = time.time() + 60
    while time.time() < until and len(set(seen)) < (5 if hours else 2):
        time.sleep(0.5)
    query.processAllAvailable()
    query.stop()
    assert connector.cursor(str(root), "all") in ("2026-01-30T03", "2026-01-31T09")  # a batch is committed when the next begins
    assert late is None and rows(spark.read.parquet(out)) == sorted([*want, ("rcl", "list-1", "list/1/new", "2026-01-31T09")])
    assert seen.count(1 if hours else 0) == 2 and os.path.isdir(root / "2026-02-01T00")


def test_hours_at_a_time_need_a_checkpoint(spark, tmp_path):
    with pytest.raises(ValueError, match="checkpoint"):
        connector.pages(spark, str(tmp_path), hours=2)


def test_missing_volumes_by_contract(spark):
    documents = spark.createDataFrame([("isap", f"DU/2024/{n}") for n in range(90)] + [("sejm", "DU/2024/x")], "source string, external_id string")
    listings = spark.createDataFrame([("DU", 2024, 100), ("MP", 2024, 0)], "code string, year int, total_count int")
    got = {r.prefix: r for r in connector.CONTRACTS["isap"].missing(documents, listings).collect()}
    assert got["DU/2024/"].archived == 90 and got["DU/2024/"].declared == 100 and got["DU/2024/"].gap and not got["MP/2024/"].gap
