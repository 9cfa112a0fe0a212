"""The archive link with keyed state: what is held already is known by key, so a batch reads nothing of the archive.

The state is Spark's own for ``dropDuplicates``, a row in RocksDB for each (source, address, content hash). A new stream is seeded from the archive as it is
stored then: the keys alone are written beside its checkpoint and come in with its first batch, the only one that is also compared with the archive.
After that a batch costs what it brings. A batch's folder is replaced when it runs again. Of equal payloads of one address in one batch
any one is archived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.archive import with_hashes
from .chain import RAW, put_batch, stored, stored_batches

KEYS = ["source", "external_id", "content_hash"]
COLUMNS = [x.split()[0] for x in RAW.split(", ")]


def first_batch(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The number of a stream's first batch in a table that may hold batches of others: found once, and kept beside the checkpoint."""
    kept = f"{checkpoint.rstrip('/')}.start"
    found = stored(spark, kept, "first long").collect()
    if found:
        return found[0]["first"]
    last = stored_batches(spark, path).agg(F.max("batch")).first()[0]
    first = 0 if last is None else last + 1
    stored(spark, path, RAW, first).select(*KEYS).write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}.seed")
    put_batch(spark.createDataFrame([(first,)], "first long").coalesce(1), kept, 0)
    return first


def archive_stream(landed: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """As ``chain.archive_stream``, over an archive that may be stored already. Needs the RocksDB state store (``alerts.use_rocksdb``).

    Its batches are numbered on from those that the archive had, and its seed is these alone: a first batch that runs again finds the same.
    """
    spark = landed.sparkSession
    first = first_batch(spark, path, checkpoint)
    rows = with_hashes(landed.withColumnRenamed("landed_at", "arrival")).select(*COLUMNS, F.lit(False).alias("seed"))
    seed = spark.readStream.schema("source string, external_id string, content_hash string").parquet(f"{checkpoint.rstrip('/')}.seed")
    both = rows.unionByName(seed.withColumn("seed", F.lit(True)), allowMissingColumns=True).dropDuplicates(KEYS)

    def each(batch_rows: DataFrame, batch: int) -> None:
        new = batch_rows.where(~F.col("seed")).select(*COLUMNS)
        if batch == 0:  # the seed came in with it: which of two equal keys was met first is not known
            held = stored(spark, path, RAW, first).select(*(F.col(c).alias(f"{c}_") for c in KEYS))
            new = new.join(held, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in KEYS], "left_anti")
        put_batch(new, path, first + batch)

    writer = both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
