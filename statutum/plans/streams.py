"""Streams over the supplied tables: each runs over what is there, is written, and what it wrote is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import connector
from ..storage import materialize, shared_path
from ..streaming import alerts as live
from ..streaming import chain, digests, keyed
from .alerts import COOLDOWN_24H
from .tables import stamp, table


def _stream(rows: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """A stored table as a stream, ``files`` of it at a time."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _written(stream: DataFrame, name: str) -> DataFrame:
    """What a stream writes until it has read all there is."""
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


#: Bytes of payloads in half a landed file, about.
ARCHIVE_BYTES = 16 << 20


def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as landed payloads, fifty addresses a source: each (source, address, hash) is archived once, over batches; half is archived before."""
    live.use_rocksdb(spark)
    d = table(spark, sf_dir, "documents").where("source is not null")
    landed = d.select("source", (F.col("doc_id") % 50).cast("string").alias("external_id"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"), F.timestamp_seconds("doc_id").alias("landed_at"))
    path = shared_path(spark, "archive")
    parts = max(2, -(-(landed.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) // ARCHIVE_BYTES))  # files of two batches: more of them, not larger ones
    for part in ("0", "1"):  # two streams, the second seeded from what the first archived, and given all of it again
        rows = landed.where(F.pmod(F.unix_seconds("landed_at"), F.lit(2)) == 0) if part == "0" else landed
        keyed.archive_stream(_stream(rows.repartition(2 * parts), "landed", parts), path, shared_path(spark, "archive-checkpoint")).awaitTermination()
    return chain.read_archive(spark, path).select("source", "external_id", "content_hash")


STREAM_ARCHIVE = "SELECT DISTINCT source, (doc_id % 50)::VARCHAR AS external_id, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE source IS NOT NULL"


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``cooldown_24h``, with the time of the last event raised in state."""
    live.use_rocksdb(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("case_key"), F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("at"), "event_id")
    return _written(live.cooldown_stream(_stream(e, "events")), "cooldown").select("event_id", "raised")


STREAM_COOLDOWN = COOLDOWN_24H


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, type and properties) once, whatever batch brings it first."""
    live.use_rocksdb(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.concat_ws("@", "event_type", "props").alias("event_key"))
    return _written(live.once_stream(_stream(e.repartition(3), "events", 1)), "once").select("owner_id", "event_key")


STREAM_ONCE = "SELECT DISTINCT user_id AS owner_id, event_type || '@' || props AS event_key FROM events"


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the users' own clocks that the watermark has passed, a zone half an hour off among them."""
    live.use_rocksdb(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.when(F.col("user_id") % 2 == 0, "Asia/Kolkata").otherwise("UTC").alias("zone"), F.to_utc_timestamp(F.col("ts"), "UTC").alias("created_at"))
    return _written(live.local_windows(_stream(e, "events")), "windows").select("owner_id", stamp("window_start"), "n")


STREAM_WINDOWS = """WITH e AS (SELECT user_id AS owner_id, CASE WHEN user_id % 2 = 0 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END AS ahead, ts FROM events),
w AS (SELECT owner_id, date_trunc('hour', ts + ahead) - ahead AS window_start, count(*) AS n FROM e GROUP BY ALL)
SELECT owner_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, n FROM w WHERE window_start <= (SELECT max(window_start) FROM w) - INTERVAL 135 MINUTE"""


def stream_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notifications of a day and a night on which clocks changed, for customers who hear every hour; urgent ones go at once."""
    live.use_rocksdb(spark)
    o = table(spark, sf_dir, "orders")
    created = F.timestamp_add("SECOND", ((F.col("o_orderkey") % 1440) * 60 + 30).cast("int"), F.lit("2024-03-30 05:00:00").cast("timestamp"))
    zone = F.when(F.col("o_custkey") % 3 == 0, "Asia/Tokyo").otherwise("Europe/Warsaw")
    none = {c: F.lit(None).cast("int") for c in ("at_hour", "on_weekday", "quiet_from", "quiet_to")}
    waiting = o.select(F.col("o_orderkey").alias("notification_id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("normal").alias("urgency"), created.alias("created_at"), F.lit("hourly").alias("mode"), zone.alias("zone")).withColumns(none)
    return _written(digests.digest_stream(_stream(waiting, "waiting")), "digests").select("notification_id", "owner_id", stamp("closed_at"))


STREAM_DIGESTS = """WITH w AS (SELECT o_orderkey::VARCHAR AS notification_id, o_custkey::VARCHAR AS owner_id, o_orderpriority = '1-URGENT' AS critical, TIMESTAMP '2024-03-30 05:00:30' + to_minutes(o_orderkey % 1440) AS created FROM orders),
c AS (SELECT *, CASE WHEN critical THEN created ELSE date_trunc('hour', created) + INTERVAL 1 HOUR END AS closed_at FROM w)
SELECT notification_id, owner_id, strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at FROM c WHERE critical OR closed_at <= (SELECT max(created) FROM w) - INTERVAL 15 MINUTE"""


def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed in hours and chunks, the last hour still open, and read through the connector's stream."""
    p = table(spark, sf_dir, "pages").where("page_id is not null")
    hour = F.format_string("2024-03-30T%02d", F.pmod("page_id", F.lit(5)))
    rows = p.select(hour.alias("hour"), F.lit("sejm").alias("source"), F.concat(F.lit("term"), F.pmod("page_id", F.lit(3)).cast("string")).alias("chunk"), F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("external_id"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    root, checkpoint, path = (shared_path(spark, n) for n in ("landing", "pages-checkpoint", "pages"))
    connector.land(materialize(rows, "rows"), root)
    for h in range(4):
        connector.close_hour(root, f"2024-03-30T{h:02d}")
    stream = connector.CONTRACTS["sejm"].changes(spark, root)
    stream.writeStream.foreachBatch(lambda rows, batch: chain.put_batch(rows, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return chain.stored(spark, path, connector.SCHEMA).select("hour", "chunk", "external_id", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("payload_sha256"))


STREAM_PAGES = """SELECT '2024-03-30T0' || (page_id % 5) AS hour, 'term' || (page_id % 3) AS chunk, 'pages/' || page_id AS external_id, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes, sha256(coalesce(html, '')) AS payload_sha256 FROM pages WHERE page_id % 5 < 4"""

QUERIES = {f.__name__: f for f in (stream_archive, stream_cooldown, stream_once, stream_windows, stream_digests, stream_pages)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
