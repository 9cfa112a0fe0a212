"""The archive of raw payloads: what is new, how complete it is, and whether a run's volume looks right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import blob_key, content_hash
from .writes import insert_absent

#: Share of declared records that may be missing; runs of the recent average; share of it that is too little.
TOLERANCE, RECENT_RUNS, TOO_LITTLE = 0.005, 10, 0.2


def with_hashes(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """With ``content_hash`` and ``blob_key``."""
    return payloads.withColumn("content_hash", content_hash(F.col(payload))).withColumn("blob_key", blob_key(F.col("content_hash")))


def new_documents(existing: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rows of ``payloads(source, external_id, payload, arrival)`` to store: the first of each (source, address, hash) not held.

    The payload takes part in no shuffle but the last join-free choice; equal bytes of two sources are two rows.
    """
    return insert_absent(existing.select("source", "external_id", "content_hash"), with_hashes(payloads), ["source", "external_id", "content_hash"], "arrival")


def archive_outcomes(existing: DataFrame, payloads: DataFrame) -> DataFrame:
    """``stored`` or ``already_known`` for every row of ``payloads``; of equal rows in a batch the first to arrive is stored."""
    keys = ["source", "external_id", "content_hash"]
    rows = with_hashes(payloads).drop("payload")
    held = existing.select(*keys).distinct().withColumn("held", F.lit(True))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("arrival"))
    seen = rows.withColumn("place", place).join(held, keys, "left")
    return seen.select("source", "external_id", "content_hash", "arrival", F.when(F.col("held").isNull() & (F.col("place") == 1), "stored").otherwise("already_known").alias("outcome"))


def direct_children(documents: DataFrame, prefix: str) -> Column:
    """Whether a document's address lies directly under a prefix: nothing after it goes a level deeper."""
    rest = F.substring(F.col("external_id"), len(prefix) + 1, 1 << 30)
    return F.col("external_id").startswith(prefix) & (F.instr(rest, "/") == 0)


def direct_children_count(documents: DataFrame, source: str, prefix: str) -> DataFrame:
    """Number of archived rows (versions, not addresses) directly under a prefix."""
    return documents.where((F.col("source") == source) & direct_children(documents, prefix)).agg(F.count(F.lit(1)).alias("archived"))


def archived_by_prefix(documents: DataFrame, declared: DataFrame) -> DataFrame:
    """``declared(source, prefix, ...)`` with ``archived``, by one equality join instead of a scan for each prefix.

    A row's only possible prefix ends at the last slash of its address.
    """
    parent = F.regexp_extract("external_id", "^(.*/)[^/]*$", 1)
    counted = documents.groupBy("source", parent.alias("prefix")).agg(F.count(F.lit(1)).alias("archived"))
    return declared.join(counted, ["source", "prefix"], "left").withColumn("archived", F.coalesce("archived", F.lit(0)))


def completeness_findings(volumes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``volumes(source, prefix, declared, archived, authoritative)`` with the share missing and whether it is a gap."""
    missing = F.when(F.col("declared") > 0, (F.col("declared") - F.col("archived")) / F.col("declared")).otherwise(0.0)
    return volumes.withColumn("missing", missing).withColumn("gap", F.col("missing") > tolerance)


def completeness(findings: DataFrame) -> DataFrame:
    """For each source: gaps, and whether it is complete, which takes no gap and at least one authoritative count."""
    return findings.groupBy("source").agg(
        F.count_if("gap").alias("gaps"),
        ((F.count_if("gap") == 0) & F.coalesce(F.bool_or("authoritative"), F.lit(False))).alias("complete"),
    )


def recent_average(runs: DataFrame, last: int = RECENT_RUNS) -> DataFrame:
    """Mean of documents seen over the last succeeded runs of each (source, mode)."""
    place = F.row_number().over(Window.partitionBy("source", "mode").orderBy(F.col("finished_at").desc(), F.col("run_id").desc()))
    recent = runs.where("outcome = 'succeeded' and finished_at is not null").withColumn("place", place).where(F.col("place") <= last)
    return recent.groupBy("source", "mode").agg(F.avg("documents_seen").alias("average"))


def volume_anomalies(runs: DataFrame, sources: DataFrame, last: int = RECENT_RUNS, share: float = TOO_LITTLE) -> DataFrame:
    """Every finished run with ``anomaly``: ``below_minimum``, ``below_average`` or null.

    ``runs(run_id, source, mode, outcome, documents_seen, finished_at, unchanged)``, ``sources(source, minimum)``. The run itself
    is inside the window of its average, as it is finished before it is judged. A minimum that is set decides first.
    """
    order = Window.partitionBy("source", "mode").orderBy("finished_at", "run_id").rowsBetween(-(last - 1), 0)
    done = runs.where("outcome = 'succeeded' and finished_at is not null").withColumn("average", F.avg("documents_seen").over(order))
    seen = done.join(sources, "source", "left") if "minimum" in sources.columns else done
    low = F.coalesce(F.col("documents_seen") < F.col("minimum"), F.lit(False))
    fell = (F.col("average") >= 1.0) & (F.col("documents_seen") < share * F.col("average"))
    return seen.withColumn("anomaly", F.when(F.coalesce("unchanged", F.lit(False)), None).when(low, "below_minimum").when(fell, "below_average"))


def warnings_of(rows: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Schema drift: ``run_id, warning`` for each rule ``(kind, path, condition, detail)`` that a row breaks, as ``KIND:path (detail)``."""
    said = [F.when(when, F.concat(F.lit(f"{kind}:{path} ("), detail.cast("string"), F.lit(")"))) for kind, path, when, detail in rules]
    found = rows.select("run_id", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("warning"))
    return found


def run_ledger(events: DataFrame) -> DataFrame:
    """One row for each run from its start and finish events; a run that failed keeps its counters and has an error.

    ``events(run_id, source, mode, event, at, documents_seen, documents_stored, warnings)``, ``event`` one of ``started``,
    ``finished`` and ``failed``.
    """
    of = lambda event, c: F.max(F.when(F.col("event") == event, F.col(c)))
    failed, done = F.count_if(F.col("event") == "failed") > 0, F.count_if(F.col("event") == "finished") > 0
    listed = F.coalesce(F.max(F.size("warnings")), F.lit(0)) > 0
    return events.groupBy("run_id").agg(
        F.max("source").alias("source"),
        F.max("mode").alias("mode"),
        of("started", "at").alias("started_at"),
        F.max(F.when(F.col("event") != "started", F.col("at"))).alias("finished_at"),
        F.coalesce(F.max("documents_seen"), F.lit(0)).alias("documents_seen"),
        F.coalesce(F.max("documents_stored"), F.lit(0)).alias("documents_stored"),
        F.when(failed, 1).otherwise(0).alias("errors"),
        F.when(failed, "failed").when(done & listed, "partial").when(done, "succeeded").alias("outcome"),
    )
