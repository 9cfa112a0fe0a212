"""Register of the lower house: landed JSON payloads to typed rows, and what an incremental or backfill read takes.

Payloads are archive rows ``(external_id, payload string, ..)``. A payload that is no JSON gives nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_date, iso_timestamp
from ..functions.ids import parliament_address, print_address, voting_address
from ..functions.vocabulary import DRAFT_TYPES, TITLE_FIELD, initiator_of, lookup, outcome_of, parliament_kind, stage_of

STAGE = "struct<date:string,stageName:string,stageType:string,printNumber:string>"
PROCESS = f"number string, term int, title string, documentTypeEnum string, processStartDate string, closureDate string, passed boolean, ELI string, rclNum string, changeDate string, stages array<{STAGE}>"
TERM = "num int, current boolean, `from` string, `to` string, prints struct<count:int,lastChanged:string>"
PROCEEDING = "number int, title string, dates array<string>"
#: Rows of a backfill chunk.
PROCEEDINGS_PER_CHUNK, PROCESSES_PER_CHUNK = 10, 100


def field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def read_landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON files, each one document or an array of documents; no schema is inferred."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def classified(documents: DataFrame) -> DataFrame:
    """``documents(external_id, payload)`` with ``kind, title, published_at``; shapes that are not known are ``unknown``."""
    rows = documents.withColumn("kind", parliament_kind(F.col("external_id")))
    payload = F.col("payload")
    title = F.coalesce(*[F.when(F.col("kind") == k, field(payload, f)) for k, f in TITLE_FIELD.items()])
    day = F.when(F.col("kind") == "print", field(payload, "documentDate")).when(F.col("kind") == "process", field(payload, "processStartDate")).when(F.col("kind") == "proceeding", field(payload, "dates[0]"))
    published = F.coalesce(iso_date(day).cast("timestamp"), F.when(F.col("kind") == "voting", iso_timestamp(field(payload, "date"))))
    return rows.withColumn("title", F.when(F.trim(title) != "", title)).withColumn("published_at", published)


def processes(documents: DataFrame) -> DataFrame:
    """Drafts out of process payloads: ``address, term, number, title, initiator, started_on, closed_on, outcome, eli, rcl_number, stages``.

    Only bills and draft resolutions are drafts. A stage's ordinal is its place from 0; nested stages are left out.
    """
    p = documents.select("external_id", F.from_json("payload", PROCESS).alias("p"))
    p = p.where(F.col("p.documentTypeEnum").isin(*DRAFT_TYPES) & F.col("p.number").isNotNull())
    stages = F.transform(
        F.coalesce("p.stages", F.array().cast(f"array<{STAGE}>")),
        lambda s, i: F.struct(i.alias("ordinal"), iso_date(F.substring(s["date"], 1, 10)).alias("day"), stage_of(s["stageType"], s["stageName"]).alias("stage")),
    )
    ends = F.filter("p.stages", lambda s: s["stageType"] == "End")
    closed = iso_date(F.col("p.closureDate"))
    return p.select(
        print_address(F.col("p.term"), F.col("p.number")).alias("address"),
        F.col("p.term").alias("term"),
        F.col("p.number").alias("number"),
        F.col("p.title").alias("title"),
        initiator_of(F.coalesce("p.title", F.lit(""))).alias("initiator"),
        iso_date(F.col("p.processStartDate")).alias("started_on"),
        closed.alias("closed_on"),
        outcome_of(closed.isNotNull(), F.try_element_at(ends, F.lit(-1))["stageName"], F.coalesce("p.passed", F.lit(False))).alias("outcome"),
        F.col("p.ELI").alias("eli"),
        F.col("p.rclNum").alias("rcl_number"),
        stages.alias("stages"),
    )


def unmapped_stages(documents: DataFrame) -> DataFrame:
    """Dated stage rows whose type names no stage, by type."""
    rows = documents.select(F.explode(F.from_json("payload", PROCESS)["stages"]).alias("s")).where(iso_date(F.substring("s.date", 1, 10)).isNotNull())
    return rows.where(stage_of(F.col("s.stageType"), F.col("s.stageName")).isNull()).groupBy(F.col("s.stageType").alias("stage_type")).agg(F.count(F.lit(1)).alias("n"))


def addressed(rows: DataFrame, kind: str, term: Column, key: Column, parent: Column | None = None) -> DataFrame:
    """Rows of a register with their external id; rows without a key are dropped."""
    address = voting_address(term, parent, key) if kind == "voting" else parliament_address(term, kind, key)
    return rows.withColumn("external_id", address).where(F.col("external_id").isNotNull())


def proceeding_address(rows: DataFrame) -> DataFrame:
    """``rows(term, number, dates)`` with addresses: by number, or by first date where the sitting has none (0 or null)."""
    key = F.when(F.coalesce("number", F.lit(0)) > 0, F.col("number").cast("string")).otherwise(F.try_element_at("dates", F.lit(1)))
    return addressed(rows, "proceeding", F.col("term"), key)


def changed_since(rows: DataFrame, changed_at: str, watermark: Column) -> DataFrame:
    """Rows after a watermark; rows without a change time always count as changed, and so do all without a watermark."""
    return rows.where(watermark.isNull() | F.col(changed_at).isNull() | (F.col(changed_at) > watermark))


def next_watermark(rows: DataFrame, changed_at: str, watermark: Column) -> DataFrame:
    """The watermark after a read: it never moves back."""
    return rows.agg(F.greatest(F.max(changed_at), watermark).alias("watermark"))


def registers_changed(terms: DataFrame, last_changed: Column) -> DataFrame:
    """The current term if its prints changed since the cursor: a missing stamp always counts as changed."""
    stamp = F.col("prints.lastChanged")
    return terms.where(F.col("current") & (stamp.isNull() | ~stamp.eqNullSafe(last_changed)))


def declared_volumes(terms: DataFrame, listed: DataFrame) -> DataFrame:
    """How much the register says it holds: ``source, partition, kind, prefix, declared, authoritative``.

    ``terms(term, prints struct<count>)`` states prints, which is binding; ``listed(term, kind, n)`` are lengths of other lists, which
    may be cut by the register, so they only warn.
    """
    stated = terms.select("term", F.lit("print").alias("kind"), F.col("prints.count").cast("long").alias("declared"), F.lit(True).alias("authoritative"))
    rows = stated.unionByName(listed.select("term", "kind", F.col("n").cast("long").alias("declared"), F.lit(False).alias("authoritative")))
    partition = F.concat(F.lit("term"), F.col("term").cast("string"))
    return rows.where("declared is not null").select(F.lit("sejm").alias("source"), partition.alias("partition"), "kind", F.concat_ws("/", partition, "kind", F.lit("")).alias("prefix"), "declared", "authoritative")


def backfill_chunk(rows: DataFrame, partition: str, order: str, after: Column, size: int) -> DataFrame:
    """The next ``size`` rows of each partition after a position, with ``done``: whether nothing is left behind them."""
    window = Window.partitionBy(partition)
    rest = rows.where(after.isNull() | (F.col(order) > after))
    numbered = rest.withColumn("place_", F.row_number().over(window.orderBy(order))).withColumn("left_", F.count(F.lit(1)).over(window))
    return numbered.where(F.col("place_") <= size).withColumn("done", F.col("left_") <= size).drop("place_", "left_")


def chunk_cursor(chunk: DataFrame, partition: str, order: str) -> DataFrame:
    """The position after a chunk as a map, as cursors are stored."""
    done = F.when(F.bool_and("done"), F.create_map(F.lit("done"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    return chunk.groupBy(partition).agg(F.map_concat(F.create_map(F.lit("last"), F.max(order).cast("string")), done).alias("position"))
