"""The event chain as streams: landed payloads to archive, archive to documents and versions, those to acts and drafts.

Each link reads the table that the one before appends to and calls the batch operators in ``foreachBatch``. A batch
writes its own folder ``batch=<id>`` and replaces it when it is run again, and it looks only at what earlier batches hold, so a
redelivered batch leaves the table as it was. Offsets move when a batch is committed: a failure repeats the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.ids import stable_id
from ..operators import archive, legislative
from ..operators.writes import documents_of, insert_absent, version_chain
from ..sources import gazette, government, parliament


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A table of batch folders, as batches before a number left it; an empty one if nothing was written yet."""
    table = stored_batches(spark, path, schema)
    return (table if before is None else table.where(F.col("batch") < before)).drop("batch")


def stored_batches(spark: SparkSession, path: str, schema: str = "") -> DataFrame:
    """A table of batch folders with the column ``batch``."""
    schema = f"{schema}, batch long" if schema else "batch long"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return spark.createDataFrame([], schema)


def put_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Replace a batch's folder; readers see it whole or not at all."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def link(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame], once: bool = True) -> StreamingQuery:
    """Run one link of the chain: ``step(rows, batch)`` gives what the batch adds to the table at ``path``."""

    def each(rows: DataFrame, batch: int) -> None:
        put_batch(step(rows, batch), path, batch)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


RAW = "source string, external_id string, payload binary, arrival timestamp, content_hash string, blob_key string"
DOCUMENTS = "source string, external_id string, title string, kind string, published_at timestamp, content_hash string, arrival timestamp, payload string"


def archive_stream(landed: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """``landed(source, external_id, payload, landed_at)`` to the archive of payloads not held yet."""

    def step(rows: DataFrame, batch: int) -> DataFrame:
        held = stored(rows.sparkSession, path, RAW, batch)
        return archive.new_documents(held, rows.withColumnRenamed("landed_at", "arrival"))

    return link(landed, path, checkpoint, step, once)


CLASSIFIERS = {"sejm": parliament.classified, "isap": gazette.classified, "rcl": government.classified}


def classified(rows: DataFrame) -> DataFrame:
    """Documents of all sources with kind, title and time; those of unknown sources are ``unknown``."""
    parts = []
    for source, classify in CLASSIFIERS.items():
        done = classify(rows.where(F.col("source") == source))
        parts.append(done.withColumn("published_at", F.col("published_at") if "published_at" in done.columns else F.lit(None).cast("timestamp")))
    others = rows.where(~F.col("source").isin(*CLASSIFIERS)).withColumns({"kind": F.lit("unknown"), "title": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp")})
    columns = [x.split()[0] for x in DOCUMENTS.split(", ")]
    out = others.select(*columns)
    for part in parts:
        out = out.unionByName(part.select(*columns))
    return out


def document_stream(raw: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The archive to classified sightings; ``documents_of`` and ``version_chain`` of that table are documents and versions."""
    return link(raw, path, checkpoint, lambda rows, batch: classified(rows.withColumn("payload", F.col("payload").cast("string"))), once)


def document_tables(sightings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and their versions."""
    keyed = sightings.withColumn("document_id", stable_id(F.col("source"), F.col("external_id")))
    return documents_of(sightings), version_chain(keyed)


EDGES = "stated_by string, version_no int, from_eli string, to_eli string, relation string"
FACTS = "draft_id string, ordinal int, stage string, valid_from timestamp, valid_to timestamp, exception boolean, known_at timestamp"


def act_stream(sightings: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Classified sightings to parsed acts, each with the arrival of its statement."""

    def step(rows: DataFrame, batch: int) -> DataFrame:
        acts = rows.where("kind = 'act'")
        return gazette.parsed_acts(acts).join(acts.select(F.get_json_object("payload", "$.ELI").alias("eli"), "arrival"), "eli").dropDuplicates(["eli", "arrival"])

    return link(sightings, path, checkpoint, step, once)


def fact_stream(sightings: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Classified sightings to stage facts not stated before; what restates a fact is absorbed."""

    def step(rows: DataFrame, batch: int) -> DataFrame:
        held = stored(rows.sparkSession, path, FACTS, batch)
        known = rows.agg(F.max("arrival").alias("known"))
        facts = legislative.stage_facts(parliament.processes(rows.where("kind = 'process'")), F.lit(None).cast("timestamp"))
        cards = legislative.government_facts(government.project_cards(rows.where("kind = 'rcl-project'").select(F.col("payload").alias("html"))), F.lit(None).cast("timestamp"))
        columns = [x.split()[0] for x in FACTS.split(", ")]
        both = facts.select(*columns).unionByName(cards.select(*columns)).drop("known_at").join(F.broadcast(known)).withColumnRenamed("known", "known_at")
        return insert_absent(held, both.where("valid_from is not null and (valid_to is null or valid_to > valid_from)"), ["draft_id", "stage", "valid_from", "valid_to"], "known_at").select(*columns)

    return link(sightings, path, checkpoint, step, once)


read_archive = partial(stored, schema=RAW)
read_documents = partial(stored, schema=DOCUMENTS)
read_facts = partial(stored, schema=FACTS)


def follow(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream over a table of batch folders."""
    reader = spark.readStream.schema(f"{schema}, batch long")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
