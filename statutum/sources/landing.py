"""Landed payload files, read by Spark's own file source, in batches and as a stream.

Files lie under a folder for each source and are named by the address of what they hold, percent-encoded; a payload that lands again gets
a new name, ``address@anything.json``. A stream keeps a log of the files it has read in its checkpoint and takes every other file,
whatever its time: files of the same second, files copied with older times and files renamed into place late are all read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: How much older than the newest file seen a file may be for a stream to take it.
OLDEST = "36500d"
_OPTIONS = {"recursiveFileLookup": "true", "pathGlobFilter": "[!._]*"}


def address_of(path: Column) -> Column:
    """The address that a file's name encodes, without version and ending."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?:@[^@.]*)?(?:\.[A-Za-z0-9]+)?$", "")
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def landed(files: DataFrame, folder: str) -> DataFrame:
    """``source, external_id, payload, landed_at`` of files as Spark's binary source gives them."""
    root = folder.rstrip("/").rpartition("://")[2]
    below = F.regexp_extract("path", f"{_quoted(root)}/([^/]+)/", 1)
    return files.select(F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))).alias("source"), address_of(F.col("path")).alias("external_id"), F.col("content").alias("payload"), F.col("modificationTime").alias("landed_at"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else f"\\{c}" for c in text)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All landed files of a folder."""
    return landed(spark.read.format("binaryFile").options(**_OPTIONS).load(folder), folder)


def stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """A stream of landed files, ``files`` of them at a time."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).options(**_OPTIONS).option("maxFileAge", OLDEST)
    return landed((reader.option("maxFilesPerTrigger", files) if files else reader).load(folder), folder)
