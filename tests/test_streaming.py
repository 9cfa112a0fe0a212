"""Streams give what batches give, however the input is split, and repeated batches change nothing."""

import json
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from statutum.functions import dates
from statutum.operators import alerts, archive, writes
from statutum.sources import landing
from statutum.streaming import alerts as live
from statutum.streaming import chain, keyed

from .test_sources import CARD, PROCESS, land


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None
    query.stop()


def test_chain_from_landed_files_to_facts(spark, tmp_path):
    folder, out = tmp_path / "landed", tmp_path / "out"
    folder.mkdir()

    def pass_all():
        landed = landing.stream(spark, str(folder))
        run(chain.archive_stream(landed, f"{out}/raw", f"{out}/c1"))
        run(chain.document_stream(chain.follow(spark, f"{out}/raw", chain.RAW), f"{out}/documents", f"{out}/c2"))
        documents = chain.follow(spark, f"{out}/documents", chain.DOCUMENTS)
        run(chain.fact_stream(documents, f"{out}/facts", f"{out}/c3"))
        run(chain.act_stream(documents, f"{out}/acts", f"{out}/c4"))

    land(folder, "sejm", "term10/process/8842", PROCESS)
    (folder / "rcl").mkdir()
    (folder / "rcl" / "projekt%2Fustawy%2F640.html").write_text(CARD)
    land(folder, "isap", "DU/2026/1", {"ELI": "DU/2026/1", "title": "Ustawa"})
    land(folder, "other", "x", {})
    pass_all()
    facts = chain.read_facts(spark, f"{out}/facts")
    assert facts.count() == 5 and facts.where("stage = 'proces_rzadowy'").count() == 1
    documents = chain.read_documents(spark, f"{out}/documents")
    assert {(r.source, r.kind, r.title) for r in documents.collect()} == {("sejm", "process", "Obywatelski projekt ustawy o latarniach"), ("rcl", "rcl-project", "O latarniach morskich"), ("isap", "act", "Ustawa"), ("other", "unknown", None)}
    assert spark.read.parquet(f"{out}/acts").count() == 1
    later = PROCESS | {"stages": [*PROCESS["stages"], {"date": "2031-03-26", "stageName": "Prezydent podpisał", "stageType": "PresidentSignature"}]}
    land(folder, "sejm", "term10/process/8842", later, "2")
    pass_all()
    assert chain.read_facts(spark, f"{out}/facts").count() == 7  # the new stage, and the period that it closes
    assert sorted(r.version_no for r in chain.document_tables(chain.read_documents(spark, f"{out}/documents"))[1].where(F.col("previous_hash").isNotNull()).collect()) == [2]


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", b"1", datetime(2026, 1, 1)), ("s", "b", b"2", datetime(2026, 1, 1))], "source string, external_id string, payload binary, arrival timestamp")
    path = str(tmp_path / "raw")
    for batch in (0, 1, 0, 1):
        held = chain.stored(spark, path, chain.RAW, batch)
        chain.put_batch(archive.new_documents(held, rows), path, batch)
        assert chain.read_archive(spark, path).count() == 2


@pytest.mark.parametrize("files", [1, 3])
def test_cooldown_of_a_stream_equals_the_batch(spark, tmp_path, files):
    live.use_rocksdb(spark)
    rows = [("o" if i % 3 else "p", "c" if i % 2 else "d", i * 7 * 3600, i) for i in range(60)]
    schema = "owner_id string, case_key string, at long, event_id long"
    whole = spark.createDataFrame(rows, schema)
    want = {r.event_id: r.raised for r in alerts.cooldown(whole).collect()}
    source = tmp_path / "in"
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = live.cooldown_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    out = str(tmp_path / "out")
    run(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out))
    assert {r.event_id: r.raised for r in spark.read.parquet(out).collect()} == want


def test_once_and_local_windows(spark, tmp_path):
    schema = "owner_id string, event_key string, zone string, created_at timestamp"
    rows = [("a", "k", "Asia/Kolkata", datetime(2026, 1, 1, 10, 20)), ("a", "k", "Asia/Kolkata", datetime(2026, 1, 1, 10, 40)), ("a", "m", "Asia/Kolkata", datetime(2026, 1, 1, 20, 0))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    once = live.once_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    run(once)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    windows = live.local_windows(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(str(tmp_path / "w"))
    run(windows)
    got = {(r.window_start, r.n) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert (datetime(2026, 1, 1, 9, 30), 1) in got and (datetime(2026, 1, 1, 10, 30), 1) in got  # hours of the owner's clock


@pytest.mark.parametrize("mode", ["hourly", "daily", "weekly"])
def test_windows_of_owners_clocks_equal_the_batch(spark, tmp_path, mode):
    """Each window once and whole, over changes of clocks and two zones, but for the last ones, which the watermark has not passed."""
    rows = [("a" if i % 3 else "b", "Europe/Warsaw" if i % 3 else "Asia/Kolkata", 8, 3, datetime(2026, 3, 20) + timedelta(minutes=47 * i)) for i in range(900)]
    schema = "owner_id string, zone string, at_hour int, on_weekday int, created_at timestamp"
    whole = spark.createDataFrame(rows, schema)
    start = dates.digest_boundary(F.lit(mode), F.col("zone"), F.col("at_hour"), F.col("on_weekday"), F.col("created_at"))
    want = {(r.owner_id, r.s): r["count"] for r in whole.groupBy("owner_id", start.alias("s")).count().collect()}
    for k in range(3):
        spark.createDataFrame(rows[k * 300 : k * 300 + 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(live.local_windows(stream, mode).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")))
    found = [((r.owner_id, r.window_start), r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert len(found) == len(dict(found)) and all(want[k] == n for k, n in found)
    span = timedelta(hours=2 * live.HOURS[mode] + 3)
    assert {k for k in want if k[1] < rows[-1][4] - span} <= set(dict(found))


def test_streamed_payloads_are_json(spark):
    assert json.loads(json.dumps(PROCESS))["term"] == 10
    assert writes.drop_unnumbered_proceedings(spark.createDataFrame([("term1/proceeding/0",), ("term1/proceeding/10",), (None,)], "external_id string")).count() == 2


def archive_batches(spark, folder, parts):
    schema = "source string, external_id string, payload binary, landed_at timestamp"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_keyed_archive_equals_the_chain(spark, tmp_path):
    """Seeded from a stored archive, batch by batch, then again from its checkpoint: what ``new_documents`` archives, and no more when it runs again."""
    live.use_rocksdb(spark)
    at = lambda k: datetime(2026, 1, 1) + timedelta(minutes=k)
    old = [("s", "a", b"1", at(0)), ("s", "b", b"2", at(1)), (None, "n", b"0", at(1))]
    schema = "source string, external_id string, payload binary, arrival timestamp"
    path = str(tmp_path / "raw")
    chain.put_batch(archive.new_documents(chain.stored(spark, path, chain.RAW), spark.createDataFrame(old, schema)), path, 0)
    parts = [[("s", "a", b"1", at(9)), ("s", "a", b"3", at(12)), ("s", "a", b"3", at(11)), ("s", "c", b"1", at(10))], [("s", "b", b"2", at(20)), ("s", "c", b"4", at(21)), ("t", "a", b"1", at(22)), (None, "n", b"0", at(22))]]
    run(keyed.archive_stream(archive_batches(spark, tmp_path / "in", parts), path, str(tmp_path / "c")))
    held = chain.read_archive(spark, path).select("source", "external_id", "payload", "content_hash")
    want = archive.new_documents(spark.createDataFrame([], chain.RAW), spark.createDataFrame(old + sum(parts, []), schema)).select("source", "external_id", "payload", "content_hash")
    key = lambda frame: sorted(((r.source, r.external_id, bytes(r.payload), r.content_hash) for r in frame.collect()), key=str)
    assert key(held) == key(want) and held.count() == 7
    later = [("s", "c", b"4", at(30)), ("s", "d", b"5", at(31))]
    run(keyed.archive_stream(archive_batches(spark, tmp_path / "in", [later]), path, str(tmp_path / "c")))
    assert chain.read_archive(spark, path).count() == 8
    assert keyed.first_batch(spark, path, str(tmp_path / "c")) == 1 and keyed.first_batch(spark, path, str(tmp_path / "d")) == 4


def test_keyed_archive_after_a_fault(spark, tmp_path):
    """A first batch that was written but not committed runs again: its seed is the archive before it, and nothing is lost or twice there."""
    live.use_rocksdb(spark)
    path, at = str(tmp_path / "raw"), datetime(2026, 1, 1)
    schema = "source string, external_id string, payload binary, arrival timestamp"
    chain.put_batch(archive.new_documents(chain.stored(spark, path, chain.RAW), spark.createDataFrame([("s", "a", b"1", at)], schema)), path, 0)
    stream = archive_batches(spark, tmp_path / "in", [[("s", "a", b"1", at), ("s", "a", b"2", at), ("s", "b", b"3", at)]])
    run(keyed.archive_stream(stream, path, str(tmp_path / "c")))
    want = sorted(tuple(r) for r in chain.read_archive(spark, path).select("external_id", "content_hash").collect())
    assert len(want) == 3
    shutil.rmtree(tmp_path / "c" / "commits")  # as if it had failed after writing
    shutil.rmtree(tmp_path / "c" / "state")
    run(keyed.archive_stream(stream, path, str(tmp_path / "c")))
    assert sorted(tuple(r) for r in chain.read_archive(spark, path).select("external_id", "content_hash").collect()) == want
