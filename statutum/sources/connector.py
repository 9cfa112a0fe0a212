"""Resumable reads of landed pages: what a source's connector promises, and a stream whose offset is the connector's cursor.

Pages land in folders by hour, source and chunk (a term, a publisher's year, a list): ``root/2026-01-31T09/sejm/term10/address.json``. When an hour is
over its writer puts the file ``_closed`` into the hour's folder, and nothing lands there any more. The stream's offset is the last closed hour that
was read, so it remembers no names of files: a trigger lists folders of hours after it, and tasks list the files of their own chunk. A batch
that fails is read again from the same two hours; the cursor is committed when a batch is done, which Spark says when it begins the next. Hours are taken in order, up to the first one that is
still open.

A chunk of an hour is dealt to ``split`` tasks by a hash of the files' names, so a source that lands a third of all pages in one chunk is not one task's work.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators import archive
from ..storage import filesystem
from . import gazette, government, parliament

SCHEMA = "source string, chunk string, external_id string, payload binary, landed_at timestamp, hour string"
HOUR, CLOSED = re.compile(r"\d{4}-\d\d-\d\dT\d\d"), "_closed"
#: Bytes of payloads in a batch handed to Spark, about; tasks of a chunk.
BATCH_BYTES, SPLIT = 8 << 20, 4


@dataclass(frozen=True)
class Contract:
    """What a connector promises: its source, the chunk that an address belongs to, the kinds of its documents, and how much it declares to hold."""

    source: str
    chunk: Callable[[Column], Column]
    classified: Callable[[DataFrame], DataFrame]
    declared: Callable[..., DataFrame]

    def changes(self, spark: SparkSession, root: str, checkpoint: str | None = None, hours: int | None = None) -> DataFrame:
        """A stream of the source's pages that landed since its cursor; with ``hours`` so many at a time, for a query with that checkpoint."""
        return pages(spark, root, self.source, checkpoint, hours)

    def backfill(self, spark: SparkSession, root: str, chunk: str) -> DataFrame:
        """All pages of one chunk, of every closed hour."""
        spark.dataSource.register(LandedHours)
        return spark.read.format(LandedHours.name()).options(root=root, source=self.source, chunk=chunk).load()

    def missing(self, documents: DataFrame, *registers: DataFrame) -> DataFrame:
        """The declared volumes of its registers beside what is archived, with the share missing and whether it is a gap."""
        volumes = archive.archived_by_prefix(documents.where(F.col("source") == self.source), self.declared(*registers))
        return archive.completeness_findings(volumes)


def _part(n: int) -> Callable[[Column], Column]:
    """The first parts of an address, as a folder is named."""
    return lambda address: F.array_join(F.slice(F.split(address, "/"), F.lit(1), F.lit(n)), "-")


CONTRACTS = {
    "sejm": Contract("sejm", _part(1), parliament.classified, parliament.declared_volumes),
    "isap": Contract("isap", _part(2), gazette.classified, gazette.declared_volumes),
    "rcl": Contract("rcl", _part(2), government.classified, government.declared_volumes),
}


def pages(spark: SparkSession, root: str, source: str | None = None, checkpoint: str | None = None, hours: int | None = None) -> DataFrame:
    """A stream of landed pages, of one source or all; ``hours`` at a time needs the query's checkpoint, where its last offset is found."""
    spark.dataSource.register(LandedHours)
    if hours and not checkpoint:
        raise ValueError("hours at a time need the checkpoint of the query")
    given = {"root": root, "source": source, "checkpoint": checkpoint, "hours": hours}
    return spark.readStream.format(LandedHours.name()).options(**{k: str(v) for k, v in given.items() if v is not None}).load()


def read(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """All pages of closed hours."""
    spark.dataSource.register(LandedHours)
    given = {"root": root} | ({"source": source} if source else {})
    return spark.read.format(LandedHours.name()).options(**given).load()


def land(rows: DataFrame, root: str) -> int:
    """Write pages ``(hour, source, chunk, external_id, payload)`` as files of their hours, each whole or absent; their number.

    A task that runs again writes the same files. Hours are closed by ``close_hour``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(root)
        n = 0
        for batch in batches:
            for hour, source, chunk, address, payload in zip(*(batch.column(c).to_pylist() for c in ("hour", "source", "chunk", "external_id", "payload")), strict=True):
                folder = f"{path}/{hour}/{quote(source, safe='')}/{quote(chunk, safe='')}"
                system.create_dir(folder, recursive=True)
                name = f"{folder}/{quote(address, safe='')}.json"
                part = f"{folder}/_{zlib.crc32(name.encode()):08x}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(payload or b"")
                system.move(part, name)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    pages = rows.select("hour", "source", "chunk", "external_id", F.col("payload").cast("binary").alias("payload"))
    return pages.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def close_hour(root: str, hour: str) -> None:
    """Say that nothing lands in an hour's folder any more."""
    system, path = filesystem(root)
    system.create_dir(f"{path}/{hour}", recursive=True)
    with system.open_output_stream(f"{path}/{hour}/{CLOSED}"):
        pass


def cursor(root: str, name: str) -> str:
    """The last hour whose pages a reader of this name has finished; empty before its first."""
    system, path = filesystem(root)
    from pyarrow import fs

    place = f"{path}/_cursors/{name}"
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return ""
    with system.open_input_stream(place) as f:
        return json.loads(f.read())["hour"]


class _Hours:
    """Listings of folders: hours, and the chunks of an hour."""

    def __init__(self, options: dict):
        self.system, self.path = filesystem(options["root"])
        self.options = dict(options)

    def folders(self, place: str) -> list[str]:
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(place, allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith("_"))

    def closed(self, after: str = "", most: int | None = None) -> list[str]:
        """Hours after one, in order, up to the first that is open."""
        from pyarrow import fs

        out: list[str] = []
        for hour in self.folders(self.path):
            if hour <= after or not HOUR.fullmatch(hour):
                continue
            if len(out) == most or self.system.get_file_info(f"{self.path}/{hour}/{CLOSED}").type == fs.FileType.NotFound:
                break
            out.append(hour)
        return out

    def parts(self, hours: list[str]) -> list[InputPartition]:
        source, chunk, split = self.options.get("source"), self.options.get("chunk"), int(self.options.get("split", SPLIT))
        out = []
        for hour in hours:
            for s in [source] if source else self.folders(f"{self.path}/{hour}"):
                for c in [chunk] if chunk else self.folders(f"{self.path}/{hour}/{s}"):
                    out += [InputPartition((hour, s, c, k, split)) for k in range(split)]
        return out


def _read(root: str, part: InputPartition | None) -> Iterator[pa.RecordBatch]:
    """The pages of a part of a chunk, in bounded batches; Spark reads no part where there are none."""
    from pyarrow import fs

    if part is None:
        return
    hour, source, chunk, k, split = part.value
    system, path = filesystem(root)
    folder = fs.FileSelector(f"{path}/{hour}/{source}/{chunk}", allow_not_found=True)
    kind = pa.schema([("source", pa.string()), ("chunk", pa.string()), ("external_id", pa.string()), ("payload", pa.binary()), ("landed_at", pa.timestamp("us", tz="UTC")), ("hour", pa.string())])
    rows: list[dict] = []
    held = 0
    for found in sorted(system.get_file_info(folder), key=lambda x: x.base_name):
        name = found.base_name
        if found.type != fs.FileType.File or name[0] in "._!" or zlib.crc32(name.encode()) % split != k:
            continue
        with system.open_input_stream(found.path) as f:
            payload = f.read()
        address = unquote(re.sub(r"(?:@[^@.]*)?(?:\.[A-Za-z0-9]+)?$", "", name, count=1))
        rows.append({"source": unquote(source), "chunk": unquote(chunk), "external_id": address, "payload": payload, "landed_at": found.mtime, "hour": hour})
        held += len(payload)
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        hours = _Hours(self.options)
        return hours.parts(hours.closed())

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.options["root"], partition)


class _Stream(DataSourceStreamReader):
    """Offsets are hours. The last one planned stands in the query's checkpoint, so that a number of hours counts from there after a restart."""

    def __init__(self, options: dict):
        self.options, self.at = dict(options), None

    def initialOffset(self) -> dict:
        return {"hour": ""}

    def _planned(self) -> str:
        from pyarrow import fs

        if self.at is None and "checkpoint" in self.options:
            system, path = filesystem(self.options["checkpoint"])
            names = [x.base_name for x in system.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True)) if x.base_name.isdigit()]
            if names:
                with system.open_input_stream(f"{path}/offsets/{max(names, key=int)}") as f:
                    self.at = json.loads(f.read().decode().strip().rsplit("\n", 1)[-1])["hour"]
        return self.at or ""

    def latestOffset(self) -> dict:
        before = self._planned()
        found = _Hours(self.options).closed(before, int(self.options["hours"]) if "hours" in self.options else None)
        self.at = found[-1] if found else before
        return {"hour": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        hours = _Hours(self.options)
        return hours.parts([h for h in hours.closed(start["hour"]) if h <= end["hour"]])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.options["root"], partition)

    def commit(self, end: dict) -> None:
        system, path = filesystem(self.options["root"])
        system.create_dir(f"{path}/_cursors", recursive=True)
        with system.open_output_stream(f"{path}/_cursors/{self.options.get('source', 'all')}") as f:
            f.write(json.dumps(end).encode())


class LandedHours(DataSource):
    """Spark's name for it is ``landed_hours``; options ``root``, and ``source``, ``chunk``, ``split``, ``hours``, ``checkpoint``."""

    @classmethod
    def name(cls) -> str:
        return "landed_hours"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
