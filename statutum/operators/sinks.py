"""Tables written for others: blobs by hash, versioned search indexes, CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_folder
from .search import Index, numbered, posting_blocks, statistics

BUCKETS = ("raw", "derived", "exports")
#: Bytes of a file of blobs, about.
FILE_BYTES = 256 << 20
#: Bytes of a row group of postings, about.
GROUP_BYTES = 8 << 20


def write_blobs(rows: DataFrame, root: str, bucket: str = "raw") -> None:
    """Add blobs ``(content_hash, payload)`` that the store lacks, one row for each hash, in folders by the first two letters.

    Spark's commit makes the addition whole or absent. Presence is checked by hash alone: payloads take part in no join. Letters are
    dealt to as many tasks as their bytes need. One writer at a time adds to a bucket; blobs that two added at once are read as two equal rows.
    """
    if bucket not in BUCKETS:
        raise ValueError(f"no bucket {bucket}")
    spark, path = rows.sparkSession, f"{root}/{bucket}"
    one = rows.groupBy("content_hash").agg(F.any_value("payload").alias("payload")).withColumn("aa", F.substring("content_hash", 1, 2))
    held = read_blobs(spark, root, bucket)
    if held is not None:
        one = one.join(held.select("content_hash"), "content_hash", "left_anti")
    size = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    part = F.pmod(F.xxhash64("content_hash"), F.lit(max(1, size // (256 * FILE_BYTES))))
    one.repartition("aa", part).write.mode("append").partitionBy("aa").parquet(path)


def read_blobs(spark: SparkSession, root: str, bucket: str = "raw") -> DataFrame | None:
    """The blobs of a bucket, none if nothing was ever written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("content_hash string, payload binary, aa string").parquet(f"{root}/{bucket}")
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return None


def publish_index(entries: DataFrame, root: str, name: str = "legislative_index") -> str:
    """Build an index beside the live one, then switch the stored alias to it; the folder of the new index.

    The alias is a table of versions, the newest of which is live: a version counts from the commit of its one row, by when all of its
    tables are complete. The version before is kept, so searches that run keep their tables; what is older goes, folders and rows of the alias.
    Entries are stored by kind in order of their numbers, postings in blocks where they are made (no shuffle), in order of stems within small row groups,
    identifiers in their order, and the numbers of all entries in one row: a search reads the row groups of its stems and blocks, and takes no title apart again. This session's views
    ``name`` and ``name_postings`` follow; other sessions ask for ``live_index``.
    """
    spark, path = entries.sparkSession, f"{root}/{name}-{uuid.uuid4().hex}"
    numbered(entries).sortWithinPartitions("kind", "number").write.partitionBy("kind").parquet(f"{path}/entries")
    stored = spark.read.parquet(f"{path}/entries")
    statistics(stored).write.parquet(f"{path}/statistics")
    blocks = posting_blocks(stored, spark.read.parquet(f"{path}/statistics"))
    blocks.sortWithinPartitions("stem", "block").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    names = stored.select(F.explode("identifiers").alias("identifier"), "id", "number")
    names.repartitionByRange("identifier").sortWithinPartitions("identifier").write.parquet(f"{path}/names")
    before = _versions(spark, root, name)
    number = before[0][0] + 1 if before else 1
    spark.createDataFrame([(number, path, number)], _ALIAS).coalesce(1).write.mode("append").partitionBy("v").parquet(f"{root}/{name}.alias")
    for version, old in before[1:]:
        drop_folder(spark, old)
        drop_folder(spark, f"{root}/{name}.alias/v={version}")
    stored.createOrReplaceTempView(name)
    spark.read.parquet(f"{path}/postings").createOrReplaceTempView(f"{name}_postings")
    return path


#: A row of an alias; its folder is named by the version, so that old ones can go one by one.
_ALIAS = "version long, path string, v long"


def _versions(spark: SparkSession, root: str, name: str) -> list[tuple[int, str]]:
    """Versions of an index, the live one first: two, and more only where a publication was cut short or several ran at once."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(_ALIAS).parquet(f"{root}/{name}.alias").orderBy(F.col("version").desc(), "path").collect()
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return []
    return [(r.version, r.path) for r in rows]


def live_index(spark: SparkSession, root: str, name: str = "legislative_index") -> Index:
    """The live index, as the alias names it now."""
    found = _versions(spark, root, name)
    if not found:
        raise FileNotFoundError(f"no index {name} is published under {root}")
    return Index(*(spark.read.parquet(f"{found[0][1]}/{t}") for t in ("entries", "postings", "statistics", "names")))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, every field quoted and quotes doubled."""
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
