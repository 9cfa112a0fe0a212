"""Audit chain, jobs, tokens and constraints over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, jobs, paging, validation
from ..storage import shared_path
from .tables import now, stamp, table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit rows, a log for each user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("log_id"), F.col("event_id").alias("sequence"), F.col("event_id").alias("at_ms"), F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("actor"), F.lit(None).cast("string").alias("actor_label"),
        F.col("event_type").alias("action"), F.col("props").alias("resource"), F.lit("succeeded").alias("outcome"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("peer"),
    )


def hash_chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose hash covers that of the row before, where each row before stands alone: links and contents are checked."""
    rows = _log(spark, sf_dir)
    own = audit.entry_hash(F.lit(None), *[F.col(c) for c in audit.FIELDS])
    before = F.lag("own_").over(Window.partitionBy("log_id").orderBy("sequence"))
    linked = rows.withColumn("own_", own).withColumn("previous_hash", before)
    linked = linked.withColumn("hash", F.when(F.col("action") == "signup", F.lit("x")).otherwise(F.col("own_")))
    return audit.broken_entries(linked).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


HASH_CHAIN_LINKS = r"""WITH r AS (SELECT user_id, event_id, event_type, sha256(concat_ws(chr(10), '', event_id, CASE WHEN event_type <> 'error' THEN user_id::VARCHAR ELSE '' END, '', event_type, props, 'succeeded', '200', '')) AS own FROM events),
l AS (SELECT *, lag(own) OVER w AS previous, lag(CASE WHEN event_type = 'signup' THEN 'x' ELSE own END) OVER w AS before, row_number() OVER w AS n, CASE WHEN event_type = 'signup' THEN 'x' ELSE own END AS hash FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT l.*, sha256(concat_ws(chr(10), coalesce(previous, ''), e.event_id, CASE WHEN e.event_type <> 'error' THEN e.user_id::VARCHAR ELSE '' END, '', e.event_type, props, 'succeeded', '200', '')) AS should FROM l JOIN events e USING (event_id)),
b AS (SELECT CASE WHEN n > 1 AND previous IS DISTINCT FROM before THEN 'link' WHEN hash <> should THEN 'content' END AS why FROM m)
SELECT why, count(*) AS n FROM b WHERE why IS NOT NULL GROUP BY 1"""


def hash_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains built and verified, one row of each log edited afterwards: the first sign-up of each user."""
    built = audit.chain(_log(spark, sf_dir))
    edited = built.withColumn("resource", F.when(F.col("action") == "signup", F.lit("edited")).otherwise(F.col("resource")))
    return audit.verify(edited).select("log_id", "checked", "intact", "broken_at", "why")


HASH_CHAIN_VERIFY = """WITH b AS (SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS broken_at FROM events GROUP BY 1)
SELECT user_id AS log_id, count(*) FILTER (broken_at IS NULL OR event_id < broken_at) AS checked, any_value(broken_at) IS NULL AS intact, any_value(broken_at) AS broken_at, CASE WHEN any_value(broken_at) IS NOT NULL THEN 'content' END AS why FROM events JOIN b USING (user_id) GROUP BY 1"""


def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.history(_log(spark, sf_dir), "7", 50).select("sequence", "action", "resource")


AUDIT_HISTORY = "SELECT event_id AS sequence, event_type AS action, props AS resource FROM events WHERE user_id = 7 AND event_type <> 'error' ORDER BY event_id DESC LIMIT 50"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: status and priority from the order's, dates as times, customers as keys."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("run_after"), (F.col("o_orderkey") % 12).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), F.concat(F.lit("backfill:"), F.col("o_custkey").cast("string")).alias("dedup_key"), F.col("o_orderdate").alias("locked_at"), F.col("o_orderdate").alias("requested_at"))


_JOBS = "jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderpriority[1:1]::INT AS priority, o_orderdate AS run_after, o_orderkey % 12 AS attempts, 'backfill:' || o_custkey AS dedup_key FROM orders)"


def claim_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claim(_jobs(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")).select("job_id", "status", F.col("attempts").cast("long").alias("attempts"))


CLAIM_TOP_K = f"WITH {_JOBS} SELECT job_id, 'running' AS status, attempts + 1 AS attempts FROM jobs WHERE status = 'pending' AND run_after <= TIMESTAMP '1998-01-01' ORDER BY priority, run_after, job_id LIMIT 8"


def enqueue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders asked for again: customers with a live one of the same priority are left out."""
    all_ = _jobs(spark, sf_dir).withColumn("dedup_key", F.concat_ws(":", "dedup_key", "priority"))
    return jobs.enqueue(all_, all_.where("status = 'done'")).select("job_id", "dedup_key")


ENQUEUE_DEDUP = f"""WITH {_JOBS}, k AS (SELECT * REPLACE (dedup_key || ':' || priority AS dedup_key) FROM jobs) SELECT job_id, dedup_key FROM k j WHERE status = 'done' AND NOT EXISTS (SELECT 1 FROM k l WHERE l.dedup_key = j.dedup_key AND l.status IN ('pending', 'running'))
QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY run_after, job_id) = 1"""


def backoff_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.after_failure(_jobs(spark, sf_dir)).select("job_id", "status", "delay_from", "delay_to")


BACKOFF_BOUNDS = f"""WITH {_JOBS}, w AS (SELECT job_id, attempts, least(5 * pow(2, least(attempts, 10)), 3600)::DOUBLE AS w FROM jobs)
SELECT job_id, CASE WHEN attempts >= 5 THEN 'dead' ELSE 'pending' END AS status, CASE WHEN attempts < 5 THEN w / 2 END AS delay_from, CASE WHEN attempts < 5 THEN w END AS delay_to FROM w"""


def reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_depth(jobs.reclaim(_jobs(spark, sf_dir), F.lit("1998-01-01 00:10:00").cast("timestamp")))


RECLAIM = f"WITH {_JOBS} SELECT CASE WHEN status = 'running' AND run_after < TIMESTAMP '1998-01-01 00:10:00' - INTERVAL 15 MINUTE THEN 'pending' ELSE status END AS status, count(*) AS jobs FROM jobs GROUP BY 1"


def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources with an interval by nation, orders as runs that finished where their status is not O."""
    c = table(spark, sf_dir, "customer")
    sources = c.select(F.col("c_custkey").alias("source"), (F.col("c_acctbal") > 0).alias("enabled"), (F.col("c_nationkey") * 86400 * 30).alias("interval_s"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("finished_at"))
    return jobs.due_sources(sources, runs, F.lit("1998-08-01").cast("timestamp")).select("source", stamp("last"))


DUE_SOURCES = """SELECT c_custkey AS source, strftime(l, '%Y-%m-%d %H:%M:%S') AS last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS l FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) ON o_custkey = c_custkey
WHERE c_acctbal > 0 AND (l IS NULL OR l + to_days(c_nationkey * 30) <= TIMESTAMP '1998-08-01')"""


def unfinished_backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("done"), F.lit("true"))).when(F.col("o_orderstatus") == "P", F.create_map(F.lit("last"), F.lit("5"))).otherwise(F.create_map(F.lit("done"), F.lit("false")))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("partition"), F.when(F.col("o_orderpriority") == "1-URGENT", "incremental").otherwise("backfill").alias("mode"), position.alias("position"))
    return jobs.unfinished_backfills(c).select("partition")


UNFINISHED_BACKFILLS = "SELECT o_orderkey AS partition FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F'"


def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "customer").select(F.lit("backfill").alias("source"), F.col("c_custkey").cast("string").alias("partition"))
    live = _jobs(spark, sf_dir).withColumn("dedup_key", F.concat(F.lit("backfill:"), "dedup_key"))
    return jobs.backfill_summary(jobs.backfill_plan(parts, live))


BACKFILL_PLAN = "SELECT count(*) AS partitions, count(*) FILTER (NOT live) AS queued, count(*) FILTER (live) AS already_in_flight FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P')) AS live FROM customer)"


def token_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as presentations of their order's token, customers as families: a second use is a reuse that ends the family."""
    o = table(spark, sf_dir, "orders")
    tokens = o.select(F.col("o_orderkey").alias("token_id"), F.col("o_custkey").alias("family_id"), F.timestamp_add("DAY", F.lit(1500), F.col("o_orderdate").cast("timestamp")).alias("expires_at"), F.lit(None).cast("timestamp").alias("used_at"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate").cast("timestamp")).alias("revoked_at"))
    shown = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token_id"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return jobs.present_tokens(shown, tokens).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


TOKEN_ROTATION = """WITH p AS (SELECT l_orderkey AS t, l_shipdate AS sh, o_custkey AS f, o_orderdate + INTERVAL 1500 DAY AS x, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS r FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT *, min(sh) FILTER (sh <= x) OVER (PARTITION BY t) AS u FROM p),
l AS (SELECT *, coalesce(sh <= x AND u + INTERVAL 15 SECOND < sh, FALSE) AS late FROM s),
z AS (SELECT *, min(sh) FILTER (late) OVER (PARTITION BY f) AS st FROM l)
SELECT CASE WHEN f IS NULL THEN 'unknown' WHEN coalesce(r <= sh, FALSE) OR coalesce(st < sh, FALSE) OR (late AND st = sh) THEN 'reuse' WHEN sh > x THEN 'expired' ELSE 'rotated' END AS outcome, count(*) AS n FROM z GROUP BY 1"""


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three tables that break a rule, as sources, preferences and references would."""
    c = table(spark, sf_dir, "customer")
    sources = c.select("c_custkey", (F.col("c_acctbal") > 0).alias("enabled"), F.when(F.col("c_nationkey") > 5, "law").alias("legal_basis"))
    mode = F.when(F.col("c_mktsegment") == "BUILDING", "daily").when(F.col("c_mktsegment") == "MACHINERY", "weekly").when(F.col("c_mktsegment") == "HOUSEHOLD", "often").otherwise("immediate")
    prefs = c.select("c_custkey", mode.alias("mode"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") + 5).alias("at_hour"), F.lit(None).cast("int").alias("on_weekday"), F.lit(None).cast("int").alias("quiet_from"), F.lit(None).cast("int").alias("quiet_to"))
    eli = lambda k: F.concat(F.lit("DU/2024/"), F.col(k).cast("string"))
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), eli("l_suppkey").alias("from_eli"), eli("l_partkey").alias("to_eli"), F.when(F.col("l_returnflag") == "R", "cites").otherwise("amends").alias("relation"))
    out = validation.violations(sources, "source", "c_custkey").unionByName(validation.violations(prefs, "delivery_preference", "c_custkey"))
    return out.unionByName(validation.violations(refs, "act_reference", "k"))


CONSTRAINT_VIOLATIONS = """WITH p AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'daily' WHEN 'MACHINERY' THEN 'weekly' WHEN 'HOUSEHOLD' THEN 'often' ELSE 'immediate' END AS mode, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 5 END AS h FROM customer),
r AS (SELECT (l_orderkey * 10 + l_linenumber)::VARCHAR AS k, l_suppkey = l_partkey AS same, l_returnflag = 'R' AS odd FROM lineitem)
SELECT 'source' AS table_name, 'enabled_needs_legal_basis' AS rule, c_custkey::VARCHAR AS key FROM customer WHERE c_acctbal > 0 AND c_nationkey <= 5
UNION ALL SELECT 'delivery_preference', 'mode', c_custkey::VARCHAR FROM p WHERE mode = 'often'
UNION ALL SELECT 'delivery_preference', 'hour_where_daily_or_weekly', c_custkey::VARCHAR FROM p WHERE mode = 'weekly'
UNION ALL SELECT 'delivery_preference', 'weekday_where_weekly', c_custkey::VARCHAR FROM p WHERE mode = 'weekly'
UNION ALL SELECT 'delivery_preference', 'hour', c_custkey::VARCHAR FROM p WHERE h > 23
UNION ALL SELECT 'act_reference', 'different_ends', k FROM r WHERE same UNION ALL SELECT 'act_reference', 'relation', k FROM r WHERE odd"""


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicates(table(spark, sf_dir, "part"), "part", ["p_name", "p_brand"]).select("table_name", "key", "n")


DUPLICATE_KEYS = "SELECT 'part' AS table_name, p_name || '|' || p_brand AS key, count(*) AS n FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL GROUP BY p_name, p_brand HAVING count(*) > 1"


def newest_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.newest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 100).select("o_orderkey")


NEWEST_LIST = "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 100"


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.after(table(spark, sf_dir, "orders"), "o_orderkey", 500, 50).select("o_orderkey", "o_orderstatus")


KEYSET_PAGE = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50"


def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that are given restrict, others do not."""
    rows = paging.where_given(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None, o_custkey=[], o_orderkey=None)
    return rows.select("o_orderkey")


OPTIONAL_FILTERS = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.dates import page_count, trailing_number

    o = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("Lista projektów według wybranych kryteriów: "), F.col("o_custkey").cast("string"), F.lit(" "))
    return o.select("o_orderkey", page_count(trailing_number(said), F.lit(100)).alias("pages"))


PAGE_COUNTS = "SELECT o_orderkey, CASE WHEN o_custkey > 0 THEN ceil(o_custkey / 100)::BIGINT ELSE 0 END AS pages FROM orders"


def status_by_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range comparison with a fixed moment: what happened in the last days before it."""
    return table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz")) & (F.col("ts") < now().cast("timestamp_ntz"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


STATUS_BY_NOW = "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-28' AND ts < TIMESTAMP '2024-02-15 12:00:00' GROUP BY 1"

def history_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows written as CSV and read back, quotes and all."""
    path = shared_path(spark, "history")
    audit.history_csv(_log(spark, sf_dir), path)
    rows = spark.read.csv(path, header=True, escape='"', schema="`at` string, action string, resource string, outcome string, status string")
    return rows.select("action", "resource", "outcome", "status").groupBy("action", "resource", "outcome", "status").agg(F.count(F.lit(1)).alias("n"))


HISTORY_CSV = "SELECT event_type AS action, props AS resource, 'succeeded' AS outcome, '200' AS status, count(*) AS n FROM events GROUP BY ALL"


def owned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owner of most orders may see of them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("owner_id"))
    owner = o.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "owner_id").first()
    return paging.owned_by(o, owner["owner_id"] if owner else "")


OWNED_ROWS = """WITH w AS (SELECT o_custkey::VARCHAR AS owner_id FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT o_orderkey, owner_id FROM orders JOIN w ON o_custkey::VARCHAR = owner_id"""

QUERIES = {f.__name__: f for f in (history_csv, owned_rows, hash_chain_links, hash_chain_verify, audit_history, claim_top_k, enqueue_dedup, backoff_bounds, reclaim, due_sources, unfinished_backfills, backfill_plan, token_rotation, constraint_violations, duplicate_keys, newest_list, keyset_page, optional_filters, page_counts, status_by_now)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
