"""The audit log: rows chained by hashes, their verification, and an owner's history."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("at_ms", "actor", "actor_label", "action", "resource", "outcome", "status", "peer")
LINK, CONTENT = "link", "content"


def entry_hash(previous: Column, *fields: Column) -> Column:
    """SHA-256 over the hash before and a row's fields, one a line, nulls as empty lines."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(x.cast("string"), F.lit("")) for x in (previous, *fields)]), 256)


def chain(rows: DataFrame, log: str = "log_id") -> DataFrame:
    """Append-only rows ``(log_id, sequence, ..)`` with ``previous_hash`` and ``hash``.

    Each hash covers the one before, which no parallel plan can shorten: one log is walked by one task, different logs
    by different ones. A log is sorted by Spark and walked in Arrow batches; only the last hash is held.
    """
    spark = rows.sparkSession
    schema = rows.schema.add("previous_hash", "string").add("hash", "string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(batches):
        current, last = None, None
        for batch in batches:
            previous, hashes = [], []
            for key, fields in zip(batch[log].tolist(), batch[list(FIELDS)].astype(object).itertuples(index=False, name=None), strict=True):
                if key != current:
                    current, last = key, None
                previous.append(last)
                last = hashlib.sha256("\n".join("" if x is None or x != x else str(x) for x in (last, *fields)).encode()).hexdigest()
                hashes.append(last)
            yield batch.assign(previous_hash=pd.Series(previous, dtype=object, index=batch.index), hash=hashes)

    typed = rows.withColumns({c: F.col(c).cast("string") for c in FIELDS})
    out = typed.repartition(parts, log).sortWithinPartitions(log, "sequence").mapInPandas(walk, typed.schema.add("previous_hash", "string").add("hash", "string"))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def broken_entries(rows: DataFrame, log: str = "log_id") -> DataFrame:
    """Entries that break their chain: ``log, sequence, why``. A log's first row may point at anything."""
    order = Window.partitionBy(log).orderBy("sequence")
    checked = rows.withColumn("before_", F.lag("hash").over(order)).withColumn("n_", F.row_number().over(order))
    link = (F.col("n_") > 1) & ~F.col("previous_hash").eqNullSafe(F.col("before_"))
    content = ~F.col("hash").eqNullSafe(entry_hash(F.col("previous_hash"), *[F.col(c) for c in FIELDS]))
    return checked.where(link | content).select(log, "sequence", F.when(link, LINK).otherwise(CONTENT).alias("why"))


def verify(rows: DataFrame, log: str = "log_id") -> DataFrame:
    """Report for each log: rows checked before the first break, whether it is intact, and where and why it breaks."""
    first = broken_entries(rows, log).groupBy(log).agg(F.min(F.struct("sequence", "why")).alias("b")).select(log, F.col("b.sequence").alias("broken_at"), F.col("b.why").alias("why"))
    joined = rows.select(log, "sequence").join(first, log, "left")
    sound = F.col("broken_at").isNull() | (F.col("sequence") < F.col("broken_at"))
    return joined.groupBy(log).agg(F.count_if(sound).alias("checked"), F.min("broken_at").isNull().alias("intact"), F.min("broken_at").alias("broken_at"), F.min("why").alias("why"))


def history(rows: DataFrame, actor: str, limit: int = 100) -> DataFrame:
    """An actor's newest entries; the limit is between 1 and 1000."""
    return rows.where(F.col("actor") == actor).orderBy(F.col("sequence").desc()).limit(min(max(limit, 1), 1000))


def history_csv(rows: DataFrame, path: str) -> None:
    """Write an owner's history as CSV: a header, every field quoted, quotes doubled. Null fields are empty."""
    shown = rows.select(F.timestamp_millis("at_ms").cast("string").alias("at"), "action", "resource", "outcome", F.coalesce(F.col("status").cast("string"), F.lit("")).alias("status"))
    shown.write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
