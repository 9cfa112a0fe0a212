"""The folder that driver and executors share, and tables stored in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: The folder of the run that is open, if there is one.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only where the session has none (a local test) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='statutum-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{_RUN.get() or shared_dir(spark) + '/statutum'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all tables that operators store meanwhile; it goes when the run is over, so results are to be written or read before."""
    path = shared_path(spark, "run")
    held = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(held)
        drop_folder(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again; cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Names that clusters give to stores, and pyarrow's for them; mounted ones are folders.
SCHEMES, MOUNTED = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasb": "abfss", "wasbs": "abfss"}, {"dbfs": "/dbfs"}


def place_of(uri: str) -> str:
    """A location as pyarrow names it."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file") or scheme in MOUNTED:
        return MOUNTED.get(scheme, "") + urlparse(uri).path.rstrip("/")
    return SCHEMES.get(scheme, scheme) + uri[len(scheme) :].rstrip("/")


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for local and mounted folders and the stores of ``SCHEMES`` and of pyarrow."""
    from pyarrow import fs

    place = place_of(uri)
    return (fs.LocalFileSystem(), place) if place.startswith("/") else fs.FileSystem.from_uri(place)
