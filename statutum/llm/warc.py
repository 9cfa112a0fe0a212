"""WARC archives: a writer, and a reader whose tasks each take a byte range of a file.

Every record is its own gzip member, so a file can be entered at any member. A reading task scans its byte range for the
gzip magic, takes a place as a record's start only if inflating there gives a WARC header, and owns the records that start
inside its range; it reads on past the end of the range to finish the last one. A task that writes begins a new file when one has
``FILE_BYTES``. A false magic inside compressed data
fails to inflate to a header and is passed over. Ranges are as many as the bytes need, whatever the number of files.

Payloads that are equal (in SHA-256 and length; the SHA-1 that archives print names no payload here): the rows with the largest page_id hold the bytes (``response``), the others refer to that page
(``revisit``, whose block is the HTTP header alone, with the payload's length in Content-Length). A null html is an empty
payload, a null url an empty target, a null page_id is named ``null`` and refers or is referred to last. Equal rows that tie
as largest are all responses. An empty table gives no archive and no rows. Other columns are ignored, whatever their names. A very long
html is one record, deflated and inflated in one task. Rows are in order within a file, so a task that runs again writes the same bytes under the same name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, shared_path, shuffle_partitions, write_file

MAGIC = b"\x1f\x8b\x08"
#: Bytes a reading task owns; bytes read at once; bytes inflated to tell a record from chance; bytes of a file, about.
RANGE_BYTES, READ_BYTES, PROBE_BYTES, FILE_BYTES = 8 << 20, 1 << 20, 64, 1 << 30
RECORD = "page_id {0}, payload_bytes long, payload_digest string, record_type string, refers_to {0}, target_uri string, payload binary, file string, offset long"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, html: bytes | None, refers_to, revisit: bool) -> bytes:
    """One record as one gzip member."""
    payload = html or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; the files written as ``file, bytes, records``."""
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"sha": F.unhex(F.sha2("html", 256)), "size": F.octet_length("html")})
    owner = rows.groupBy("sha", "size").agg(F.max("page_id").alias("owner"))
    rows = rows.join(owner, ["sha", "size"]).select("page_id", "url", "html", "owner", "sha", "size", (F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        members = (record(*row) for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "owner", "revisit")), strict=True))
        part, task = 0, TaskContext.get().partitionId()
        count = size = 0

        def file_of(first: bytes) -> Iterator[bytes]:
            nonlocal count, size
            count = size = 0
            for member_ in chain([first], members):
                count += 1
                size += len(member_)
                yield member_
                if size >= FILE_BYTES:
                    return

        while (first := next(members, None)) is not None:
            name = f"{folder}/part-{task:06d}-{part:04d}.warc.gz"
            written = write_file(name, file_of(first))
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([written], pa.int64()), "records": pa.array([count], pa.int64())})
            part += 1

    ordered = rows.sortWithinPartitions("page_id", "sha", "size", "url")  # a second attempt of a task writes the same bytes
    return ordered.select("page_id", "url", "html", "owner", "revisit").mapInArrow(run, "file string, bytes long, records long")


class _Window:
    """Reads of a file forward in large pieces, kept only as far as they are needed."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.data):
            if at + n > self.size:
                n = max(0, self.size - at)
            if at < self.start or at + n > self.start + len(self.data):
                self.source.seek(at)
                self.start, self.data = at, self.source.read(max(n, READ_BYTES))
        return self.data[at - self.start : at - self.start + n]


def member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at an offset and the offset after it; None if no record starts there."""
    probe = zlib.decompressobj(31)
    try:
        if not probe.decompress(window.get(at, 512), PROBE_BYTES).startswith(b"WARC/1."):
            return None
        inflate, parts, place = zlib.decompressobj(31), [], at
        while not inflate.eof:
            piece = window.get(place, 1 << 16)
            if not piece:
                return None  # cut off
            parts.append(inflate.decompress(piece))
            place += len(piece)
        return b"".join(parts), place - len(inflate.unused_data)
    except zlib.error:
        return None


def parse(data: bytes, id_of) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    length = next(int(x.partition(":")[2]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:"))
    if kind == "response" and (len(payload) != length or _digest(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    named = lambda x: None if x is None or x == "<urn:page:null>" else id_of(x[len("<urn:page:") : -1])
    return {
        "page_id": named(fields["warc-record-id"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": named(fields.get("warc-refers-to")),
        "target_uri": fields.get("warc-target-uri", ""),
        "payload": payload if kind == "response" else None,
    }


def read_warc(spark: SparkSession, files: DataFrame, id_type: str = "long", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives in ``files(file, bytes)``, one task for each few byte ranges."""
    bounded_batches(spark)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("file", "bytes", starts.alias("start")).repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), "file", "start")
    id_of = str if id_type == "string" else int
    schema, name = RECORD.format(id_type), {"string": pa.string(), "int": pa.int32()}.get(id_type, pa.int64())
    kinds = {"payload_bytes": pa.int64(), "offset": pa.int64(), "payload": pa.binary(), "page_id": name, "refers_to": name}
    arrow = pa.schema([(c, kinds.get(c, pa.string())) for c in (x.split()[0] for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for file, size, start in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "start")), strict=True):
                system, path = filesystem(file)
                with system.open_input_file(path) as source:
                    window, at, end = _Window(source, size), start, min(start + range_bytes, size)
                    while at < end:
                        piece = window.get(at, min(READ_BYTES, end - at + len(MAGIC) - 1))
                        found = piece.find(MAGIC)
                        if found < 0:
                            at += max(1, len(piece) - len(MAGIC) + 1)
                            continue
                        at += found
                        if at >= end:
                            break
                        got = member(window, at)
                        if got is None:
                            at += 1
                            continue
                        out.append(parse(got[0], id_of) | {"file": file, "offset": at})
                        held += len(got[0])
                        at = got[1]
                        if held > 8 << 20 or len(out) >= 2000:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return ranges.mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    The list of files (one row for each task that wrote) comes to the driver as in any listing of files.
    """
    spark = pages.sparkSession
    written = write_warc(pages, shared_path(spark, "warc")).collect()
    files = spark.createDataFrame([(r.file, r.bytes) for r in written], "file string, bytes long")
    return read_warc(spark, files, pages.schema["page_id"].dataType.simpleString().replace("bigint", "long"))
