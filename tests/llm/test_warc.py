import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from statutum.llm import warc
from statutum.llm.common import filesystem, place_of
from statutum.llm.queries import op2_warc

SCHEMA = "page_id long, url string, html string, file string"


def brute(rows):
    payload = [(i, (h or "").encode()) for i, h in rows]
    last = {}
    for i, p in payload:
        if i is not None:
            last[p] = max(i, last.get(p, i))
    return sorted(((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if last.get(p, i) == i else "revisit", None if last.get(p, i) == i else last[p]) for i, p in payload), key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (4, None), (5, ""), (6, "ż" * 70_000), (7, "\r\n\r\nContent-Length: 3\r\n"), (8, "\x1f\x8b\x08 WARC/1.1"), (None, "b"), (None, "own"), (-9, "a")]


@pytest.mark.parametrize("range_bytes", [50, 1000, 8 << 20])
def test_round_trip(spark, tmp_path, range_bytes):
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i} y\nz", h, "clash") for i, h in ROWS], SCHEMA).repartition(3)
    files = warc.write_warc(pages, f"file://{tmp_path}/w").collect()
    assert sum(f.records for f in files) == len(ROWS)
    listed = spark.createDataFrame([(f.file, f.bytes) for f in files], "file string, bytes long")
    read = warc.read_warc(spark, listed, range_bytes=range_bytes)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()), key=str)
    assert got == brute(ROWS)
    assert {r.payload.decode() for r in read.where("record_type = 'response'").collect()} == {h or "" for _, h in ROWS}


def test_members_are_plain_gzip_and_false_magic_is_passed_over(spark, tmp_path):
    import os

    inner = gzip.compress(b"WARC?" + os.urandom(3000), mtime=0)
    pages = spark.createDataFrame([(i, "u", inner.hex() + str(i)) for i in range(30)], "page_id long, url string, html string").withColumn("html", F.col("html")).repartition(1)
    (f,) = warc.write_warc(pages, f"file://{tmp_path}/w").collect()
    system, path = filesystem(f.file)
    data = gzip.decompress(open(path, "rb").read())
    assert data.count(b"WARC/1.1\r\n") == 30
    junk = f"{tmp_path}/junk.warc.gz"
    with open(path, "rb") as whole, open(junk, "wb") as out:
        out.write(b"\x1f\x8b\x08junk\x1f\x8b\x08" + inner + whole.read() + b"\x1f\x8b\x08")
    listed = spark.createDataFrame([(f"file://{junk}", os.path.getsize(junk))], "file string, bytes long")
    assert sorted(r.page_id for r in warc.read_warc(spark, listed, range_bytes=700).collect()) == list(range(30))


def test_full_files_are_followed_by_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = [(i, f"http://x/{i}", f"page {i % 20} " * 30) for i in range(100)]
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w").collect()
    assert len(files) > 8 and len({f.file for f in files}) == len(files) and sum(f.records for f in files) == 100 and max(f.bytes for f in files) < 3500
    listed = spark.createDataFrame([(f.file, f.bytes) for f in files], "file string, bytes long")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, listed).collect()), key=str)
    assert got == brute([(i, h) for i, _, h in rows])


def test_places_of_stores():
    for uri, place in (("s3a://b/x", "s3://b/x"), ("dbfs:/a/b", "/dbfs/a/b"), ("file:///a", "/a"), ("/a", "/a"), ("hdfs://h:1/a", "hdfs://h:1/a"), ("gs://b/a", "gs://b/a"), ("wasbs://c@a/x", "abfss://c@a/x")):
        assert place_of(uri) == place


def test_ids_of_other_types_and_no_pages(spark):
    rows = spark.createDataFrame([("a", "u", "x"), ("b", "u", "x")], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.warc_round_trip(rows).collect()} == {("a", "b"), ("b", None)}
    assert warc.warc_round_trip(rows.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op2_warc(spark, sf_dir).collect()), key=str) == brute(rows)


def test_attempts_write_the_same_bytes(spark, tmp_path):
    """Rows that reach a task in another order, with other columns beside them and a long page among them, make the same files."""
    rows = [(i % 40, f"https://x.example/{i}", "<p>" + "wave " * (i % 7), "x", i) for i in range(120)] + [(500, None, "long " * 400_000, "x", 1), (None, None, None, None, None)]
    kind = "page_id long, url string, html string, sha string, owner long"
    made = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else partitions follow sizes, which follow the order
    for seed in (1, 2):
        folder = tmp_path / str(seed)
        pages = spark.createDataFrame(rows, kind).repartition(3, "page_id").sortWithinPartitions(F.rand(seed))
        list_ = warc.write_warc(pages, f"file://{folder}").collect()
        made.append(sorted((f.name.rpartition("-")[2], f.read_bytes()) for f in folder.iterdir()))
        assert sum(r.records for r in list_) == len(rows)
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(made[0]) > 1 and sorted(b for _, b in made[0]) == sorted(b for _, b in made[1])
