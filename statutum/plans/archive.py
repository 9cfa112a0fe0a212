"""Archive, versions, completeness and volume over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import blob_key, content_hash
from ..operators import archive as op
from ..operators import sinks, stored, writes
from ..storage import shared_path
from .tables import sql_stamp, stamp, table

_PAYLOADS_SQL = "payloads AS (SELECT source, lang AS external_id, doc_id AS arrival, sha256(coalesce(text, '')) AS h FROM documents)"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads that a language's address returned one after the other."""
    return table(spark, sf_dir, "documents").select("source", F.col("lang").alias("external_id"), F.coalesce("text", F.lit("")).alias("payload"), F.col("doc_id").alias("arrival"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes into an archive that holds all documents of src0 already."""
    rows = _payloads(spark, sf_dir)
    held = op.with_hashes(rows.where("source = 'src0'"))
    return op.new_documents(held, rows).select("source", "external_id", "content_hash", "arrival", "blob_key")


CONTENT_DEDUP = f"""WITH {_PAYLOADS_SQL} SELECT source, external_id, h AS content_hash, min(arrival) AS arrival, h[1:2] || '/' || h[3:4] || '/' || h AS blob_key
FROM payloads WHERE source <> 'src0' GROUP BY source, external_id, h"""


def archive_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir)
    held = op.with_hashes(rows.where("source = 'src1'"))
    return op.archive_outcomes(held, rows).groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"))


ARCHIVE_OUTCOMES = f"""WITH {_PAYLOADS_SQL}, o AS (SELECT source, CASE WHEN source <> 'src1' AND row_number() OVER (PARTITION BY source, external_id, h ORDER BY arrival) = 1 THEN 'stored' ELSE 'already_known' END AS outcome FROM payloads)
SELECT source, outcome, count(*) AS n FROM o GROUP BY ALL"""


def blob_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = content_hash(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", blob_key(h).alias("blob_key"))


BLOB_KEYS = "WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS h FROM pages) SELECT page_id, h[1:2] || '/' || h[3:4] || '/' || h AS blob_key FROM p"


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents, event types as contents: a type that comes back makes no new version."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.sha2("event_type", 256).alias("content_hash"), F.col("ts").alias("arrival"))
    return writes.version_chain(rows).select("document_id", F.col("version_no").cast("long").alias("version_no"), "content_hash", "previous_hash", stamp("first_seen"))


VERSION_CHAIN = f"""WITH f AS (SELECT user_id AS document_id, sha256(event_type) AS content_hash, min(ts) AS first_seen FROM events GROUP BY ALL)
SELECT document_id, row_number() OVER w AS version_no, content_hash, lag(content_hash) OVER w AS previous_hash, {sql_stamp('first_seen')} FROM f WINDOW w AS (PARTITION BY document_id ORDER BY first_seen, content_hash)"""


def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents: the newest title that is not null (events over 60 have none), the first kind."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.lit("events").alias("source"), F.col("user_id").alias("external_id"), F.when(F.col("value") <= 60, F.col("props")).alias("title"), F.col("event_type").alias("kind"), F.col("event_id").alias("arrival"))
    return writes.documents_of(rows)


DOCUMENT_UPSERT = "SELECT 'events' AS source, user_id AS external_id, arg_max(props, event_id) FILTER (value <= 60) AS title, arg_min(event_type, event_id) AS kind FROM events GROUP BY user_id"


def latest_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer as what an upsert leaves."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return writes.one_per_key(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


LATEST_WRITE = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that line items name, but no large returned ones do: first line of each."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"), "l_returnflag", "l_quantity")
    return writes.insert_absent(li.where("l_returnflag = 'R' and l_quantity = 50"), li, ["l_partkey"], "arrival").select("l_partkey", "arrival")


INSERT_ABSENT = "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS arrival FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50) GROUP BY 1"


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the first half of the month as stored statuses, of the second as updates that leave the first value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts")
    old = writes.latest(e.where("ts < timestamp_ntz '2024-01-16'"), ["user_id"], "event_id")
    return writes.merge_latest(old, e.where("ts >= timestamp_ntz '2024-01-16'"), ["user_id"], "event_id", keep=("value",)).select("user_id", "event_type", "value", "event_id")


UPSERT_MERGE = """WITH o AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
n AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(o.value, n.value) AS value, coalesce(n.event_id, o.event_id) AS event_id FROM o FULL JOIN n USING (user_id)"""


def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``upsert_merge``, in a kept table: its first half, then the second, then the second again, which changes nothing."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts")
    kept = stored.Table(spark, shared_path(spark, "statuses"), "user_id long, event_type string, value double, event_id long, ts timestamp_ntz", ("user_id",), 32)
    for late in (False, True, True):
        kept.upsert(e.where("ts >= timestamp_ntz '2024-01-16'" if late else "ts < timestamp_ntz '2024-01-16'"), "event_id", keep=("value",))
    return kept.read().select("user_id", "event_type", "value", "event_id", F.lit(kept.version()).alias("version"))


STORED_UPSERT = f"SELECT *, 2::BIGINT AS version FROM ({UPSERT_MERGE})"


def append_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a history stated twice, once as it was known on the 20th: what the second statement adds, by stage."""
    from ..operators.legislative import stage_timeline
    from .tables import stages

    rows = stages(spark, sf_dir)
    state = lambda r, known: stage_timeline(r).withColumns({"known_at": F.lit(known).cast("timestamp"), "exception": F.lit(False)})
    before = state(rows.where("day <= '2024-01-20'"), "2024-01-21")
    return writes.append_facts(before, state(rows, "2024-02-01")).groupBy("stage").agg(F.count(F.lit(1)).alias("facts"))


def _facts_sql(where: str) -> str:
    return f"""SELECT draft_id, stage, day AS valid_from, CASE WHEN f IS NOT NULL THEN greatest(f, day + 1) END AS valid_to FROM
(SELECT user_id AS draft_id, event_type AS stage, ts::DATE AS day, lead(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) AS f FROM events {where})"""


APPEND_FACTS = f"SELECT stage, count(*) AS facts FROM (({_facts_sql('')}) EXCEPT ({_facts_sql("WHERE ts::DATE <= DATE '2024-01-20'")})) GROUP BY 1"


def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers get a first order only if they have none: those of segment BUILDING have 0 already."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0).cast("long")).alias("act"))
    return writes.set_where_null(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("act")), "k", "act")


CONDITIONAL_UPDATE = "SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE m END::BIGINT AS act FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey"


def direct_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the folder that they lie directly under."""
    p = table(spark, sf_dir, "pages").select(F.lit("web").alias("source"), F.col("url").alias("external_id"))
    folders = p.select("source", F.regexp_extract("external_id", "^(.*/)[^/]*$", 1).alias("prefix")).distinct()
    return op.archived_by_prefix(p, folders).select("prefix", "archived")


DIRECT_CHILDREN = "SELECT regexp_extract(url, '^(.*/)[^/]*$', 1) AS prefix, count(*) AS archived FROM pages GROUP BY 1"


def direct_children_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages directly under one folder of one host."""
    p = table(spark, sf_dir, "pages").select(F.lit("web").alias("source"), F.col("url").alias("external_id"))
    return op.direct_children_count(p, "web", "https://spam-farm.example.org/en/")


DIRECT_CHILDREN_COUNT = "SELECT count(*) AS archived FROM pages WHERE starts_with(url, 'https://spam-farm.example.org/en/') AND instr(substr(url, 34), '/') = 0"


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages as sources: declared are as many pages as their smallest folder would have everywhere."""
    volumes = direct_children(spark, sf_dir).select(F.regexp_extract("prefix", "^https?://([^/]*)", 1).alias("source"), "prefix", (F.col("archived") + F.length("prefix") % 3 - 1).alias("declared"), "archived", (F.length("prefix") % 2 == 0).alias("authoritative"))
    return op.completeness(op.completeness_findings(volumes))


COMPLETENESS = f"""WITH v AS (SELECT regexp_extract(prefix, '^https?://([^/]*)', 1) AS source, archived + length(prefix) % 3 - 1 AS declared, archived, length(prefix) % 2 = 0 AS authoritative FROM ({DIRECT_CHILDREN})),
f AS (SELECT *, CASE WHEN declared > 0 THEN (declared - archived) / declared ELSE 0 END > 0.005 AS gap FROM v)
SELECT source, count(*) FILTER (gap) AS gaps, count(*) FILTER (gap) = 0 AND bool_or(authoritative) AS complete FROM f GROUP BY 1"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a day for each event type, having seen that day's events; every seventh saw a tenth of them."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.when(F.dayofmonth("d") % 7 == 0, F.floor(F.col("n") / 10)).otherwise(F.col("n"))
    return daily.select(F.concat_ws("-", "source", "d").alias("run_id"), "source", F.lit("incremental").alias("mode"), F.lit("succeeded").alias("outcome"), seen.alias("documents_seen"), F.col("d").cast("timestamp").alias("finished_at"), F.lit(False).alias("unchanged"))


_RUNS_SQL = """runs AS (SELECT event_type AS source, ts::DATE AS d, CASE WHEN day(ts::DATE) % 7 = 0 THEN count(*) // 10 ELSE count(*) END AS seen FROM events GROUP BY 1, 2)"""


def volume_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("click", 5), ("view", None)], "source string, minimum long")
    return op.volume_anomalies(_runs(spark, sf_dir), sources).select("run_id", "documents_seen", F.round("average", 6).alias("average"), "anomaly")


VOLUME_ANOMALY = f"""WITH {_RUNS_SQL}, a AS (SELECT *, avg(seen) OVER (PARTITION BY source ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS average FROM runs)
SELECT source || '-' || d AS run_id, seen AS documents_seen, round(average, 6) AS average,
CASE WHEN source = 'click' AND seen < 5 THEN 'below_minimum' WHEN average >= 1 AND seen < 0.2 * average THEN 'below_average' END AS anomaly FROM a"""


def recent_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.recent_average(_runs(spark, sf_dir)).select("source", F.round("average", 6).alias("average"))


RECENT_AVERAGE = f"WITH {_RUNS_SQL} SELECT source, round(avg(seen), 6) AS average FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY d DESC) <= 10) GROUP BY 1"


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: they start on their date, each line finishes or fails (returned) on its shipment."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"), F.lit("backfill").alias("mode"), F.lit("started").alias("event"), F.col("o_orderdate").alias("at"), F.lit(None).cast("long").alias("documents_seen"), F.lit(None).cast("long").alias("documents_stored"), F.array().cast("array<string>").alias("warnings"))
    li = table(spark, sf_dir, "lineitem").join(o.select("run_id"), F.col("l_orderkey") == F.col("run_id"), "left_semi")
    warned = F.when(F.col("l_tax") > 0.06, F.array(F.lit("MISSING_FIELD:/x (y)"))).otherwise(F.array().cast("array<string>"))
    ends = li.select(F.col("l_orderkey").alias("run_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("mode"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("finished").alias("event"), F.col("l_shipdate").alias("at"), F.col("l_quantity").cast("long").alias("documents_seen"), F.lit(1).cast("long").alias("documents_stored"), warned.alias("warnings"))
    out = op.run_ledger(o.unionByName(ends))
    return out.select("run_id", "source", "mode", stamp("started_at"), stamp("finished_at"), "documents_seen", "documents_stored", F.col("errors").cast("long").alias("errors"), "outcome")


RUN_LEDGER = f"""WITH l AS (SELECT l_orderkey, max(l_shipdate) AS finished_at, max(l_quantity)::BIGINT AS seen, bool_or(l_returnflag = 'R') AS failed, bool_or(l_tax > 0.06) AS warned FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, o_orderpriority AS source, 'backfill' AS mode, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at, {sql_stamp('finished_at')}, coalesce(seen, 0) AS documents_seen, CASE WHEN l_orderkey IS NULL THEN 0 ELSE 1 END::BIGINT AS documents_stored,
CASE WHEN failed THEN 1 ELSE 0 END::BIGINT AS errors, CASE WHEN failed THEN 'failed' WHEN warned THEN 'partial' WHEN l_orderkey IS NOT NULL THEN 'succeeded' END AS outcome FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""


def schema_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("run_id", F.to_date("ts").cast("string"))
    rules = [("MISSING_FIELD", "/events[].purchase", F.col("event_type") == "error", F.col("user_id")), ("UNEXPECTED_TYPE", "/events[].value", F.col("value") > 90, F.col("event_id"))]
    return op.warnings_of(rows, rules)


SCHEMA_WARNINGS = """SELECT ts::DATE::VARCHAR AS run_id, 'MISSING_FIELD:/events[].purchase (' || user_id || ')' AS warning FROM events WHERE event_type = 'error'
UNION ALL SELECT ts::DATE::VARCHAR, 'UNEXPECTED_TYPE:/events[].value (' || event_id || ')' FROM events WHERE value > 90"""

def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' bytes as blobs, added twice and read back: each once."""
    root = shared_path(spark, "blobs")
    rows = op.with_hashes(table(spark, sf_dir, "pages").select(F.coalesce("html", F.lit("")).cast("binary").alias("payload")))
    for _ in range(2):
        sinks.write_blobs(rows.select("content_hash", "payload"), root)
    return sinks.read_blobs(spark, root).select("content_hash", F.octet_length("payload").cast("long").alias("bytes"), F.col("aa").alias("folder"))


BLOB_STORE = "SELECT DISTINCT sha256(coalesce(html, '')) AS content_hash, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes, sha256(coalesce(html, ''))[1:2] AS folder FROM pages"

QUERIES = {f.__name__: f for f in (blob_store, content_dedup, archive_outcomes, blob_keys, version_chain, document_upsert, latest_write, insert_absent, upsert_merge, stored_upsert, append_facts, conditional_update, direct_children, direct_children_count, completeness, volume_anomaly, recent_average, run_ledger, schema_warnings)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
