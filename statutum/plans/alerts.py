"""Alert decisions, cooldown, digests and deliveries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import digest_boundary, is_quiet, window_closed
from ..functions.text import plural_of_matters
from ..operators import alerts as op
from .tables import STAMP, stamp, table


def _caught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as interests that caught an order for a supplier's profile; the ship mode of a line is its kind."""
    kind = F.element_at(F.array(*map(F.lit, ("keyword", "region", "pkd", "draft", "act"))), ((F.col("l_quantity").cast("int") - 1) % 5 + 1))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("profile_id"), kind.alias("kind"), F.col("l_partkey").cast("string").alias("value"))


def best_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.best_reason(_caught(spark, sf_dir))


BEST_REASON = """SELECT l_orderkey AS item_id, l_suppkey AS profile_id, ['keyword', 'region', 'pkd', 'draft', 'act'][((l_quantity::INT - 1) % 5 + 1)::BIGINT] AS kind, l_partkey::VARCHAR AS value FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY list_position(['act', 'draft', 'pkd', 'region', 'keyword'], ['keyword', 'region', 'pkd', 'draft', 'act'][((l_quantity::INT - 1) % 5 + 1)::BIGINT]), l_partkey::VARCHAR) = 1"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as news: user as owner, event type as the draft's stage, the hour's number as profile."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("owner_id"), F.hour("ts").alias("profile_id"), F.lit(1).alias("version"), F.lit("keyword").alias("kind"), F.lit("x").alias("value"), F.lit("draft").alias("subject_kind"), F.get_json_object("props", "$.k").alias("subject"), F.col("event_type").alias("stage"), F.col("props").alias("title"), F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("at"))


def _rules(spark: SparkSession) -> DataFrame:
    """Profiles 0 to 2 have no rule, 3 to 5 a disabled one, 6 to 11 watch clicks and views, the rest everything."""
    r = spark.range(3, 24).select(F.col("id").alias("rule_id"), F.col("id").cast("int").alias("profile_id"), (F.col("id") > 5).alias("enabled"), F.lit("normal").alias("urgency"))
    stages = spark.range(6, 12).select(F.col("id").alias("rule_id"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("stage"))
    return op.rules_with_stages(r, stages)


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules say before anything raised earlier is looked at."""
    return op.standing_reasons(_candidates(spark, sf_dir), _rules(spark)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_VERDICT = "CASE WHEN hour(ts) < 3 THEN 'no_rule' WHEN hour(ts) < 6 THEN 'rule_disabled' WHEN hour(ts) < 12 AND event_type NOT IN ('click', 'view') THEN 'stage_not_watched' END"
RULE_VERDICTS = f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM events GROUP BY 1"


def decision_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's decision; what was raised before falls on a later one of the same matter."""
    empty = spark.createDataFrame([], "owner_id long, case_key string, event_key string, at long")
    return op.decide(_candidates(spark, sf_dir), _rules(spark), empty).select(F.col("item_id").alias("event_id"), "case_key", "event_key", "decision", "reason")


DECISION_CASCADE = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, 'draft:' || json_extract_string(props, '$.k') AS c, 'draft:' || json_extract_string(props, '$.k') || '@' || event_type AS ek, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS sec, hour(ts) AS p, {_VERDICT} AS v FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, c ORDER BY sec, p, event_id) AS i FROM e WHERE v IS NULL),
w(event_id, user_id, c, i, last, told, reason) AS (
SELECT event_id, user_id, c, i, sec, [ek], 'matched' FROM o WHERE i = 1
UNION ALL SELECT o.event_id, o.user_id, o.c, o.i, CASE WHEN o.sec - w.last <= 86400 OR list_contains(w.told, o.ek) THEN w.last ELSE o.sec END,
CASE WHEN o.sec - w.last <= 86400 OR list_contains(w.told, o.ek) THEN w.told ELSE list_append(w.told, o.ek) END,
CASE WHEN o.sec - w.last <= 86400 THEN 'case_recently_raised' WHEN list_contains(w.told, o.ek) THEN 'already_told' ELSE 'matched' END FROM w JOIN o ON o.user_id = w.user_id AND o.c = w.c AND o.i = w.i + 1)
SELECT e.event_id, e.c AS case_key, e.ek AS event_key, CASE WHEN w.reason = 'matched' THEN 'raised' ELSE 'withheld' END AS decision, coalesce(e.v, w.reason) AS reason FROM e LEFT JOIN w USING (event_id)"""


def cooldown_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events raised if more than a day after the last one raised of the same user and type."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("case_key"), F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("at"), "event_id")
    return op.cooldown(e).select("event_id", "raised")


COOLDOWN_24H = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS sec, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
w(event_id, user_id, event_type, i, last, raised) AS (SELECT event_id, user_id, event_type, i, sec, TRUE FROM e WHERE i = 1
UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.i, CASE WHEN e.sec - w.last > 86400 THEN e.sec ELSE w.last END, e.sec - w.last > 86400 FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.i = w.i + 1)
SELECT event_id, raised FROM w"""


def exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.concat_ws("@", "event_type", "props").alias("event_key"), F.col("ts").alias("at"), "event_id")
    return op.exactly_once(e).select("owner_id", "event_key", "event_id")


EXACTLY_ONCE = "SELECT user_id AS owner_id, event_type || '@' || props AS event_key, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2"


def _preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' preferences by segment; MACHINERY has none stored. Nations set hours and days, zones go by region."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'")
    mode = F.when(F.col("c_mktsegment") == "BUILDING", "daily").when(F.col("c_mktsegment") == "AUTOMOBILE", "weekly").when(F.col("c_mktsegment") == "HOUSEHOLD", "hourly").otherwise("immediate")
    quiet = F.col("c_nationkey") < 12
    return c.select(F.col("c_custkey").alias("owner_id"), mode.alias("mode"), F.when(F.col("c_nationkey") < 5, "America/New_York").otherwise("Europe/Warsaw").alias("zone"), (F.col("c_nationkey") % 24).alias("at_hour"), (F.col("c_nationkey") % 7 + 1).alias("on_weekday"), F.when(quiet, F.lit(22)).alias("quiet_from"), F.when(quiet, F.col("c_nationkey") % 9).alias("quiet_to"))


_PREFERENCES = """pref AS (SELECT c_custkey AS owner_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'daily' WHEN 'AUTOMOBILE' THEN 'weekly' WHEN 'HOUSEHOLD' THEN 'hourly' ELSE 'immediate' END AS mode,
CASE WHEN c_nationkey < 5 AND c_mktsegment <> 'MACHINERY' THEN 'America/New_York' ELSE 'Europe/Warsaw' END AS zone, c_nationkey % 24 AS h, c_nationkey % 7 + 1 AS d, CASE WHEN c_nationkey < 12 AND c_mktsegment <> 'MACHINERY' THEN 22 END AS qf, c_nationkey % 9 AS qt FROM customer)"""


def _boundary(now: str) -> str:
    local = f"timezone(zone, timezone('UTC', {now}))"
    today = f"(date_trunc('day', {local}) + to_hours(h))"
    week = f"({today} + to_days((d - isodow({local}))::INTEGER))"
    hour = f"date_trunc('hour', {local})"
    at = f"CASE mode WHEN 'hourly' THEN {hour} WHEN 'daily' THEN CASE WHEN {today} > {hour} THEN {today} - INTERVAL 1 DAY ELSE {today} END WHEN 'weekly' THEN CASE WHEN {week} > {hour} THEN {week} - INTERVAL 7 DAY ELSE {week} END END"
    return f"timezone('UTC', timezone(zone, {at}))"


_DIGEST_NOW = "2024-03-31 05:30:00"


def digest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last boundary of every customer's digests before the morning after the clocks changed, whether it closes now, and quiet."""
    p = _preferences(spark, sf_dir)
    now, since = F.lit(_DIGEST_NOW).cast("timestamp"), F.lit("2024-03-30 20:00:00").cast("timestamp")
    args = (F.col("mode"), F.col("zone"), F.col("at_hour"), F.col("on_weekday"), now)
    return p.select("owner_id", F.date_format(digest_boundary(*args), STAMP).alias("boundary"), window_closed(*args, since).alias("closed"), is_quiet(F.col("quiet_from"), F.col("quiet_to"), F.col("zone"), now).alias("quiet"))


_QUIET = "coalesce(CASE WHEN qf < qt THEN hh >= qf AND hh < qt ELSE hh >= qf OR hh < qt END AND qf IS NOT NULL, FALSE)"
DIGEST_WINDOW = f"""WITH {_PREFERENCES}, b AS (SELECT *, {_boundary(f"TIMESTAMP '{_DIGEST_NOW}'")} AS b, hour(timezone(zone, timezone('UTC', TIMESTAMP '{_DIGEST_NOW}'))) AS hh FROM pref JOIN customer ON c_custkey = owner_id WHERE c_mktsegment <> 'MACHINERY')
SELECT owner_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS boundary, mode = 'immediate' OR coalesce(b > TIMESTAMP '2024-03-30 20:00:00', FALSE) AS closed, {_QUIET} AS quiet FROM b"""


def _waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notifications that wait, raised at the hour their number names on the day before; urgent ones are critical."""
    o = table(spark, sf_dir, "orders")
    created = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), F.lit("2024-03-30 05:00:00").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("notification_id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("normal").alias("urgency"), created.alias("created_at"), F.lit("act").alias("subject_kind"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("title"), F.lit("v").alias("value"))


_WAITING = """waiting AS (SELECT o_orderkey AS notification_id, o_custkey AS owner_id, o_orderpriority = '1-URGENT' AS critical, TIMESTAMP '2024-03-30 05:00:00' + to_minutes(o_orderkey % 1440) AS created_at, o_orderpriority AS subject, o_orderstatus AS title FROM orders)"""


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("owner_id"), F.lit("2024-03-31 05:10:00").cast("timestamp").alias("closed_at"))
    return op.digests_due(_waiting(spark, sf_dir), _preferences(spark, sf_dir), last, F.lit(_DIGEST_NOW).cast("timestamp"))


_DUE = f"""{_PREFERENCES}, {_WAITING}, old AS (SELECT owner_id, min(created_at) AS oldest FROM waiting GROUP BY 1),
own AS (SELECT *, CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2024-03-31 05:10:00' ELSE oldest END AS since, {_boundary(f"TIMESTAMP '{_DIGEST_NOW}'")} AS b, hour(timezone(zone, timezone('UTC', TIMESTAMP '{_DIGEST_NOW}'))) AS hh FROM old JOIN pref USING (owner_id) JOIN customer ON c_custkey = owner_id),
opened AS (SELECT owner_id, (mode = 'immediate' OR coalesce(b > since, FALSE)) AND NOT {_QUIET} AS opened FROM own),
due AS (SELECT * FROM waiting JOIN opened USING (owner_id) WHERE critical OR opened)"""


def digests_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications that go out now; owners without stored preferences hear at once."""
    return _due(spark, sf_dir).select("notification_id", "owner_id", "urgency")


DIGESTS_DUE = f"WITH {_DUE} SELECT notification_id, owner_id, CASE WHEN critical THEN 'critical' ELSE 'normal' END AS urgency FROM due"


def digest_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matters of the digests that are due: newest title and time, number of notifications."""
    owners = _due(spark, sf_dir).withColumn("digest_id", F.col("owner_id"))
    return op.matters(owners).select(F.col("digest_id").alias("owner_id"), "subject", "title", stamp("latest"), F.size("notifications").cast("long").alias("n"))


DIGEST_MATTERS = f"WITH {_DUE} SELECT owner_id, subject, arg_max(title, (created_at, notification_id)) AS title, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest, count(*) AS n FROM due GROUP BY owner_id, subject"


def digest_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and HTML of each digest."""
    m = op.matters(_due(spark, sf_dir).withColumn("digest_id", F.col("owner_id")).withColumn("title", F.concat(F.lit("<b>"), "title", F.lit("&</b>"))))
    return op.mails(m, F.lit("https://x.example/u")).select(F.col("digest_id").alias("owner_id"), F.col("subject").alias("line"), "html")


DIGEST_MAILS = f"""WITH {_DUE}, m AS (SELECT owner_id, subject, arg_max(title, (created_at, notification_id)) AS title, max(created_at) AS latest FROM due GROUP BY owner_id, subject)
SELECT owner_id, 'Statutum: ' || count(*) || CASE WHEN count(*) = 1 THEN ' sprawa' WHEN count(*) % 10 BETWEEN 2 AND 4 AND count(*) % 100 NOT BETWEEN 12 AND 14 THEN ' sprawy' ELSE ' spraw' END AS line,
'<h1>Co się wydarzyło</h1><ul>' || string_agg('<li><strong>&lt;b&gt;' || title || '&amp;&lt;/b&gt;</strong><br><small>Pasuje do: v</small></li>', '' ORDER BY latest DESC, subject DESC) || '</ul><p><a href="https://x.example/u">Zrezygnuj z tych wiadomości</a></p>' AS html FROM m GROUP BY owner_id"""


def polish_plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", plural_of_matters(F.col("o_orderkey")).alias("form"))


POLISH_PLURAL = "SELECT o_orderkey, CASE WHEN o_orderkey = 1 THEN 'sprawa' WHEN o_orderkey % 10 BETWEEN 2 AND 4 AND o_orderkey % 100 NOT BETWEEN 12 AND 14 THEN 'sprawy' ELSE 'spraw' END AS form FROM orders"


def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as digests: customers without nation 3 have accounts, those over 9000 are suppressed, finished orders were sent."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    digests = o.select(F.col("o_orderkey").alias("digest_id"), F.col("o_custkey").alias("owner_id"))
    sent = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("digest_id"), F.lit("sent").alias("status"))
    users = c.where("c_nationkey <> 3").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit(" "), "c_name", F.lit("@X.PL")).alias("email"))
    suppressed = c.where("c_acctbal > 9000").select(F.concat("c_name", F.lit("@x.pl ")).alias("address"), F.lit("bounced").alias("reason"))
    return op.delivery_outcomes(digests, sent, users, suppressed)


DELIVERY_OUTCOMES = """WITH x AS (SELECT o_orderkey AS digest_id, o_custkey AS owner_id, o_orderstatus = 'F' AS sent, CASE WHEN c_nationkey <> 3 THEN lower(c_name) || '@x.pl' END AS address, c_acctbal > 9000 AS refused FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT digest_id, owner_id, coalesce(address, '') AS address, CASE WHEN sent THEN 'skipped' WHEN address IS NULL THEN 'failed' WHEN refused THEN 'suppressed' ELSE 'sent' END AS status,
CASE WHEN sent THEN NULL WHEN address IS NULL THEN 'no such account' WHEN refused THEN 'bounced' END AS detail FROM x"""


def suppressed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers told since a moment, as a semi join."""
    told = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1998-07-01'")
    return table(spark, sf_dir, "customer").join(told, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


SUPPRESSED_SEMI = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-07-01')"


def pending_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types and users as subjects that arrive; those with an unprocessed row (errors) do not wait twice."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("subject"), F.col("event_id").alias("arrived_at"))
    held = e.where("kind = 'error' or kind = 'view'").withColumn("processed_at", F.when(F.col("kind") == "view", F.lit("2024-01-01").cast("timestamp")))
    return op.add_pending(held, e).select("kind", "subject", "arrived_at")


PENDING_BUFFER = "SELECT event_type AS kind, user_id AS subject, min(event_id) AS arrived_at FROM events WHERE event_type <> 'error' GROUP BY 1, 2"


def next_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("subject"), F.col("ts").alias("arrived_at"), F.when(F.col("event_type") == "view", F.lit("2024-01-01").cast("timestamp")).alias("processed_at"))
    return op.next_pass(e).select("kind", "subject", F.date_format("arrived_at", STAMP).alias("arrived_at"))


NEXT_PASS = "SELECT event_type AS kind, user_id AS subject, strftime(ts, '%Y-%m-%d %H:%M:%S') AS arrived_at FROM events WHERE event_type <> 'view' ORDER BY ts, event_type, user_id LIMIT 200"

def match_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one run of passes judges of the events that wait, and in which pass."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("subject"), F.col("ts").alias("arrived_at"), F.when(F.col("event_type") == "view", F.lit("2024-01-01").cast("timestamp")).alias("processed_at"))
    return op.run_passes(e).select("kind", "subject", "pass_no")


MATCH_RUN = "SELECT event_type AS kind, event_id AS subject, (row_number() OVER (ORDER BY ts, event_type, event_id) - 1) // 200 + 1 AS pass_no FROM events WHERE event_type <> 'view' ORDER BY ts, event_type, event_id LIMIT 5000"


def resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pending items of acts (odd line numbers, by order) and drafts (even ones, by part as customer): title and stage, or nothing found."""
    li = table(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    pending = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(odd, "act").otherwise("draft").alias("kind"), F.when(odd, F.col("l_orderkey")).otherwise(F.col("l_partkey")).alias("subject"))
    acts = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("act_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("DU/2024/"), F.col("o_orderkey").cast("string")).alias("eli"))
    drafts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("draft_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("stage"))
    return op.resolve_items(pending, acts, drafts).select("l_orderkey", "l_linenumber", "kind", "title", "eli", "stage", "found")


RESOLVED_ITEMS = """WITH p AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 'act' ELSE 'draft' END AS kind, CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey ELSE l_partkey END AS subject FROM lineitem)
SELECT l_orderkey, l_linenumber, kind, coalesce(o_orderpriority, c_name) AS title, 'DU/2024/' || o_orderkey AS eli, c_mktsegment AS stage, coalesce(o_orderpriority, c_name) IS NOT NULL AS found
FROM p LEFT JOIN orders ON kind = 'act' AND o_orderkey = subject AND o_orderstatus <> 'P' LEFT JOIN customer ON kind = 'draft' AND c_custkey = subject"""

QUERIES = {f.__name__: f for f in (match_run, resolved_items, best_reason, rule_verdicts, decision_cascade, cooldown_24h, exactly_once, digest_window, digests_due, digest_matters, digest_mails, polish_plural, delivery_outcomes, suppressed_semi, pending_buffer, next_pass)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
