"""Control tables as queries: job queue, schedules, backfills, refresh tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import backoff_bounds

# Priorities of jobs, lower first.
PRIORITIES = {"interactive": 10, "normal": 100, "backfill": 500}
#: Jobs claimed at once; seconds after which a running job counts as abandoned; seconds in which a used token may come again.
CLAIM, ABANDONED_S, GRACE_S = 8, 15 * 60, 15


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs to add: the first of each dedup key that no pending or running job has; jobs without a key are all added."""
    live = jobs.where("status in ('pending', 'running') and dedup_key is not null").select("dedup_key").distinct()
    place = F.row_number().over(Window.partitionBy("dedup_key").orderBy("requested_at", "job_id"))
    keyed = wanted.where("dedup_key is not null").withColumn("place_", place).where("place_ = 1").drop("place_").join(live, "dedup_key", "left_anti")
    return keyed.select(*wanted.columns).unionByName(wanted.where("dedup_key is null"))


def claim(jobs: DataFrame, now: Column, limit: int = CLAIM) -> DataFrame:
    """The due jobs to run next, by priority then time, as running with one more attempt."""
    due = jobs.where((F.col("status") == "pending") & (F.col("run_after") <= now)).orderBy("priority", "run_after", "job_id").limit(limit)
    return due.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_at": now})


def after_failure(jobs: DataFrame) -> DataFrame:
    """Failed jobs: dead once their attempts are used up, else pending with the bounds of their delay in seconds."""
    low, high = backoff_bounds(F.col("attempts"))
    dead = F.col("attempts") >= F.col("max_attempts")
    return jobs.withColumns({"status": F.when(dead, "dead").otherwise("pending"), "delay_from": F.when(~dead, low), "delay_to": F.when(~dead, high)})


def reclaim(jobs: DataFrame, now: Column, abandoned_s: int = ABANDONED_S) -> DataFrame:
    """Running jobs locked for too long are pending again."""
    lost = (F.col("status") == "running") & (F.col("locked_at") < F.timestamp_add("SECOND", F.lit(-abandoned_s), now))
    return jobs.withColumns({"status": F.when(lost, "pending").otherwise(F.col("status")), "locked_at": F.when(~lost, F.col("locked_at"))})


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def due_sources(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Enabled sources that never finished a run, or whose interval has passed since."""
    last = runs.where("finished_at is not null").groupBy("source").agg(F.max("finished_at").alias("last"))
    joined = sources.where("enabled").join(last, "source", "left")
    return joined.where(F.col("last").isNull() | (F.timestamp_add("SECOND", F.col("interval_s"), F.col("last")) <= now))


def unfinished_backfills(cursors: DataFrame) -> DataFrame:
    """Backfill partitions whose position does not say that they are done."""
    return cursors.where((F.col("mode") == "backfill") & (F.coalesce(F.try_element_at("position", F.lit("done")), F.lit("")) != "true"))


def backfill_plan(partitions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each partition ``(source, partition)`` with ``in_flight``: whether a live job has its key."""
    key = F.concat_ws(":", F.lit("backfill"), "source", "partition")
    live = jobs.where("status in ('pending', 'running')").select(F.col("dedup_key").alias("key_")).distinct().withColumn("in_flight", F.lit(True))
    return partitions.withColumn("key_", key).join(live, "key_", "left").withColumn("in_flight", F.coalesce("in_flight", F.lit(False))).drop("key_")


def backfill_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("partitions"), F.count_if(~F.col("in_flight")).alias("queued"), F.count_if("in_flight").alias("already_in_flight"))


def present_tokens(presentations: DataFrame, tokens: DataFrame, grace_s: int = GRACE_S) -> DataFrame:
    """What each presentation ``(token_id, at)`` of a refresh token leads to, families and earlier presentations considered.

    ``rotated``, ``reuse`` (the whole family is revoked from then on), ``expired`` or ``unknown``. The first presentation of a
    token spends it; later ones within the grace period rotate again. A family is revoked by the first reuse in it.
    ``tokens(token_id, family_id, expires_at, used_at, revoked_at)``; times are timestamps.
    """
    joined = presentations.join(tokens, "token_id", "left")
    first_use = F.min(F.when(F.col("at") <= F.col("expires_at"), F.col("at"))).over(Window.partitionBy("token_id"))
    joined = joined.withColumn("spent_at", F.coalesce("used_at", first_use))
    late = F.coalesce((F.col("at") <= F.col("expires_at")) & (F.timestamp_add("SECOND", F.lit(grace_s), F.col("spent_at")) < F.col("at")), F.lit(False))
    stolen_at = F.min(F.when(late, F.col("at"))).over(Window.partitionBy("family_id"))
    joined = joined.withColumn("late", late).withColumn("stolen_at", stolen_at)
    revoked = F.coalesce(F.col("revoked_at") <= F.col("at"), F.lit(False)) | F.coalesce(F.col("stolen_at") < F.col("at"), F.lit(False))
    outcome = F.when(F.col("family_id").isNull(), "unknown").when(revoked | F.col("late") & (F.col("stolen_at") == F.col("at")), "reuse").when(F.col("at") > F.col("expires_at"), "expired").otherwise("rotated")
    return joined.select("token_id", "family_id", "at", outcome.alias("outcome"))
