"""Alert state in streams: the cooldown of a matter, notifications that are sent once, digests by local windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import digest_boundary
from ..operators.alerts import COOLDOWN_S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys that matters share.
BUCKETS = 4096


class Cooldown(StatefulProcessor):
    """Holds for each matter of a bucket the second at which it was raised last, as one value. Within a batch events are judged in order of time."""

    def __init__(self, seconds: int = COOLDOWN_S):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seconds string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = json.loads(self.last.get()[0]) if self.last.exists() else {}
        nulls_last = lambda x: (x is None, x)
        for r in sorted(rows, key=lambda r: (nulls_last(r.at), nulls_last(r.event_id))):
            raised = r.at is not None and (r.matter not in last or r.at - last[r.matter] > self.seconds)
            if raised:
                last[r.matter] = r.at
            yield Row(owner_id=r.owner_id, case_key=r.case_key, at=r.at, event_id=r.event_id, raised=raised)
        self.last.update((json.dumps(last),))

    def close(self) -> None:
        pass


def cooldown_stream(events: DataFrame, seconds: int = COOLDOWN_S) -> DataFrame:
    """``raised`` for a stream of ``(owner_id, case_key, at, event_id)`` whose batches arrive in order of time.

    Equals ``operators.alerts.cooldown`` over all events. Matters share ``BUCKETS`` keys by a hash, so a batch costs two round trips for each bucket
    that it touches. Needs the RocksDB state store, which ``use_rocksdb`` sets.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"owner_id {types['owner_id']}, case_key {types['case_key']}, at long, event_id {types['event_id']}, raised boolean"
    rows = events.select("owner_id", "case_key", F.col("at").cast("long").alias("at"), "event_id", F.to_json(F.struct("owner_id", "case_key")).alias("matter"))
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("matter"), F.lit(BUCKETS))).groupBy("bucket")
    return keyed.transformWithState(statefulProcessor=Cooldown(seconds), outputStructType=out, outputMode="Append", timeMode="None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def once_stream(events: DataFrame) -> DataFrame:
    """The first event of each (owner, event key) that arrives, for ever: the state grows with the keys, as the promise does."""
    return events.dropDuplicates(["owner_id", "event_key"])


#: Hours of a window by mode.
HOURS = {"hourly": 1, "daily": 24, "weekly": 7 * 24}


def local_windows(notifications: DataFrame, mode: str = "hourly", late_minutes: int = 15) -> DataFrame:
    """Waiting notifications by window of the owner's own clock: ``owner_id, zone, window_start, n``, times in UTC.

    ``window`` knows one zone only, so each row gets the end of its window by its owner's clock (and, for daily and weekly ones, ``at_hour``
    and ``on_weekday``), which is the time that the watermark follows: behind the newest end by the window and ``late_minutes``, so
    behind the newest row by ``late_minutes`` at most. A window is given out, once and whole, when the watermark has passed its
    end; later arrivals are left to the batch run. Owners of one mode make one stream.
    """
    zone, width = F.col("zone"), F.make_dt_interval(hours=F.lit(HOURS[mode]))
    at_hour, on_weekday = (F.col(c) if c in notifications.columns else F.lit(None).cast("int") for c in ("at_hour", "on_weekday"))
    start = digest_boundary(F.lit(mode), zone, at_hour, on_weekday, F.col("created_at"))
    ends = F.to_utc_timestamp(F.from_utc_timestamp(start, zone) + width, zone)  # by the clock: a day may have 23 or 25 hours
    timed = notifications.withColumn("window_start", start).withColumn("ends", ends).withWatermark("ends", f"{HOURS[mode] * 60 + 60 + late_minutes} minutes")
    return timed.groupBy("owner_id", "zone", "window_start", "ends").agg(F.count(F.lit(1)).alias("n")).select("owner_id", "zone", "window_start", "n")
