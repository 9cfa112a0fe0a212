"""Stages, medians, statuses, citations and cards over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import lookup
from ..operators import legislative as op
from ..operators import stored
from ..storage import materialize, shared_path
from .tables import CURRENT_SQL, DRAFTS_SQL, MOVES, NEXT, NOW, STAYS_SQL, TIMELINE_SQL, UNKNOWN, acts, drafts, history, now, sql_stamp, stages, stamp, table


def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stage_timeline(stages(spark, sf_dir)).select("draft_id", "ordinal", "stage", stamp("valid_from"), stamp("valid_to"))


STAGE_TIMELINE = f"WITH {TIMELINE_SQL} SELECT draft_id, ordinal, stage, {sql_stamp('valid_from')}, {sql_stamp('valid_to')} FROM timeline"


def stage_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_exceptions(op.stage_timeline(stages(spark, sf_dir)), MOVES, UNKNOWN).select("draft_id", "ordinal", "stage", "exception")


STAGE_EXCEPTIONS = f"""WITH {TIMELINE_SQL}, lagged AS (SELECT *, lag(stage) OVER (PARTITION BY draft_id ORDER BY valid_from, ordinal) AS b FROM timeline)
SELECT draft_id, ordinal, stage, NOT (b IS NULL OR b = stage OR b = '{UNKNOWN}' OR stage = '{UNKNOWN}' OR (b || '>' || stage) IN ({", ".join(f"'{a}>{b}'" for a, b in MOVES)})) AS exception FROM lagged"""


def current_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.current_stage(history(spark, sf_dir)).select("draft_id", "stage", stamp("since"), "ordinal")


CURRENT_STAGE = f"WITH {TIMELINE_SQL}, {CURRENT_SQL} SELECT draft_id, stage, {sql_stamp('since')}, ordinal FROM current"


def _paces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stage_paces(op.stays(op.stage_timeline(stages(spark, sf_dir)), drafts(spark, sf_dir)))


def stage_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paces(spark, sf_dir)


STAGE_PACE = f"""WITH {TIMELINE_SQL}, {DRAFTS_SQL}, {STAYS_SQL}
SELECT initiator, FALSE AS overall, stage, m AS median_seconds, n FROM own UNION ALL SELECT NULL, TRUE, stage, m, n FROM everyone"""


def as_of_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a user's stage on a day of its own, as known a day after that and five days after."""
    o = table(spark, sf_dir, "orders")
    day = F.timestamp_add("HOUR", (F.col("o_orderkey") % 1000).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    users = F.lit(table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1)
    asks = o.select(F.col("o_orderkey").alias("ask"), F.pmod("o_custkey", users).alias("draft_id"), day.alias("day"), F.explode(F.array(F.lit(1), F.lit(5))).alias("after"))
    asks = asks.withColumn("known", F.timestamp_add("DAY", F.col("after"), F.col("day")))
    return op.as_of_asks(history(spark, sf_dir), asks).select("ask", "after", "draft_id", "stage", stamp("valid_from"))


AS_OF_ASKS = f"""WITH {TIMELINE_SQL}, a AS (SELECT o_orderkey AS ask, after, o_custkey % (SELECT max(user_id) + 1 FROM events) AS draft_id, TIMESTAMP '2024-01-01' + to_hours(o_orderkey % 1000) AS day FROM orders, (VALUES (1), (5)) t(after))
SELECT ask, after, draft_id, stage, {sql_stamp('valid_from')} FROM a JOIN timeline USING (draft_id) WHERE valid_from <= day AND (valid_to IS NULL OR valid_to > day) AND valid_from + INTERVAL 2 DAY <= day + to_days(after)"""


def kept_stage_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medians of ``stage_pace`` from lengths that are kept, after three batches of drafts and a fourth that restates the second's lengths and puts them back."""
    stays = materialize(op.stays(op.stage_timeline(stages(spark, sf_dir)), drafts(spark, sf_dir)).withColumn("part", F.pmod(F.xxhash64("initiator", "seconds"), F.lit(3))), "stays")
    kept = stored.stay_lengths(spark, shared_path(spark, "lengths"))
    parts = [stays.where(F.col("part") == k).drop("part") for k in range(3)]
    longer = parts[1].withColumn("seconds", F.col("seconds") + 1)
    for stated, withdrawn in ((parts[0], None), (longer, None), (parts[2], None), (parts[1], longer)):
        stored.add_stays(kept, stated, withdrawn)
    return stored.kept_paces(kept)





def shipping_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of completed stays from order to shipment, by priority and return flag."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stays = rows.select(F.col("o_orderpriority").alias("initiator"), F.col("l_returnflag").alias("stage"), F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"))
    return op.stage_paces(stays)


SHIPPING_PACE = """WITH stays AS (SELECT o_orderpriority AS initiator, l_returnflag AS stage, date_diff('second', o_orderdate, l_shipdate) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT initiator, FALSE AS overall, stage, trunc(quantile_cont(seconds, 0.5))::BIGINT AS median_seconds, count(*) AS n FROM stays GROUP BY initiator, stage
UNION ALL SELECT NULL, TRUE, stage, trunc(quantile_cont(seconds, 0.5))::BIGINT, count(*) FROM stays GROUP BY stage"""


def stage_pace_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = drafts(spark, sf_dir).select("initiator").distinct().crossJoin(stages(spark, sf_dir).select("stage").distinct())
    return op.pace_or_fallback(wanted, _paces(spark, sf_dir), 60).select("initiator", "stage", "pace")


STAGE_PACE_FALLBACK = f"""WITH {TIMELINE_SQL}, {DRAFTS_SQL}, {STAYS_SQL}
SELECT i.initiator, s.stage, coalesce(CASE WHEN o.n >= 60 THEN o.m END, CASE WHEN e.n >= 60 THEN e.m END) AS pace
FROM (SELECT DISTINCT initiator FROM drafts) i CROSS JOIN (SELECT DISTINCT stage FROM stages) s
LEFT JOIN own o ON o.initiator = i.initiator AND o.stage = s.stage LEFT JOIN everyone e ON e.stage = s.stage"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.draft_status(drafts(spark, sf_dir), history(spark, sf_dir), _paces(spark, sf_dir), acts(spark, sf_dir), now(), lambda s: lookup(s, NEXT))


def draft_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("draft_id", "initiator", "current_stage", stamp("since"), "next_stage", stamp("expected_at"), stamp("deadline"), "deadline_kind", stamp("stalled_since"))


_STATUS_SQL = f"""
status AS (SELECT draft_id, d.initiator, c.stage AS current_stage, since,
  CASE WHEN closed_at IS NULL THEN CASE c.stage WHEN 'signup' THEN 'view' WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase' END END AS next_stage,
  coalesce(CASE WHEN o.n >= 5 THEN o.m END, CASE WHEN e.n >= 5 THEN e.m END) AS pace, closed_at, date_trunc('day', o_orderdate)::TIMESTAMP AS deadline
  FROM current c JOIN drafts d USING (draft_id) LEFT JOIN own o ON o.initiator = d.initiator AND o.stage = c.stage LEFT JOIN everyone e ON e.stage = c.stage
  LEFT JOIN orders ON o_orderkey = act_id),
told AS (SELECT draft_id, initiator, current_stage, since, next_stage, CASE WHEN next_stage IS NOT NULL THEN since + to_seconds(pace) END AS expected_at, deadline,
  CASE WHEN deadline IS NOT NULL THEN 'wejscie_w_zycie' END AS deadline_kind,
  CASE WHEN closed_at IS NULL AND since + to_seconds(2 * pace) < TIMESTAMP '{NOW}' THEN since + to_seconds(2 * pace) END AS stalled_since FROM status)"""
_STATUS_WITH = f"WITH {TIMELINE_SQL}, {DRAFTS_SQL}, {STAYS_SQL}, {CURRENT_SQL}, {_STATUS_SQL}"
DRAFT_STATUS = f"""{_STATUS_WITH}
SELECT draft_id, initiator, current_stage, {sql_stamp('since')}, next_stage, {sql_stamp('expected_at')}, {sql_stamp('deadline')}, deadline_kind, {sql_stamp('stalled_since')} FROM told"""


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stage_counts(_status(spark, sf_dir), ("click", "purchase", "signup", "view"))


STATUS_COUNTS = f"{_STATUS_WITH} SELECT current_stage, count(*) AS drafts, count(stalled_since) AS stalled FROM told WHERE current_stage IN ('click', 'purchase', 'signup', 'view') GROUP BY 1"


def as_of_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("2024-01-15").cast("timestamp")
    return op.as_of(history(spark, sf_dir), day, F.lit("2024-01-16").cast("timestamp")).select("draft_id", "ordinal", "stage", stamp("valid_from"))


AS_OF_STAGE = f"""WITH {TIMELINE_SQL} SELECT draft_id, ordinal, stage, {sql_stamp('valid_from')} FROM timeline
WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15') AND valid_from + INTERVAL 2 DAY <= TIMESTAMP '2024-01-16'"""


def draft_left_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).join(acts(spark, sf_dir), "act_id", "left").select("draft_id", "initiator", "act_id", "in_force_from")


DRAFT_LEFT_ACT = f"WITH {DRAFTS_SQL} SELECT draft_id, initiator, act_id, o_orderdate::DATE AS in_force_from FROM drafts LEFT JOIN orders ON o_orderkey = act_id"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers cite parts of their line items and the other way round; only acts of finished orders are held."""
    li = table(spark, sf_dir, "lineitem")
    label = F.element_at(F.array(*map(F.lit, ("Akty zmienione", "Akty zmieniające", "Akty uchylone", "Podstawa prawna", "Inne"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    eli = lambda c: F.concat(F.lit("DU/2024/"), c.cast("string"))
    return op.orient_edges(li.select(eli(F.col("l_suppkey")).alias("eli"), label.alias("label"), eli(F.col("l_partkey")).alias("target")))


_EDGES_SQL = """
refs AS (SELECT 'DU/2024/' || l_suppkey AS eli, ['Akty zmienione', 'Akty zmieniające', 'Akty uchylone', 'Podstawa prawna', 'Inne'][(l_linenumber % 5 + 1)::BIGINT] AS label, 'DU/2024/' || l_partkey AS target FROM lineitem),
labels(label, direction, relation) AS (VALUES ('Akty zmienione', 'from', 'amends'), ('Akty zmieniające', 'to', 'amends'), ('Akty uchylone', 'from', 'repeals'), ('Podstawa prawna', 'from', 'implements')),
edges AS (SELECT DISTINCT CASE direction WHEN 'to' THEN target ELSE eli END AS from_eli, CASE direction WHEN 'to' THEN eli ELSE target END AS to_eli, relation
  FROM refs JOIN labels USING (label) WHERE eli <> target)"""


def edge_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


EDGE_ORIENTATION = f"WITH {_EDGES_SQL} SELECT * FROM edges"


def _cited_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("act_id"), F.concat(F.lit("DU/2024/"), F.col("o_orderkey").cast("string")).alias("eli"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("announced_on"))


def citations_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.citations(_edges(spark, sf_dir), _cited_acts(spark, sf_dir), True).withColumn("place", F.col("place").cast("long"))


def citations_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.citations(_edges(spark, sf_dir), _cited_acts(spark, sf_dir), False).withColumn("place", F.col("place").cast("long"))


def _citations_sql(own: str, other: str) -> str:
    return f"""WITH {_EDGES_SQL}, acts AS (SELECT 'DU/2024/' || o_orderkey AS e, o_orderpriority AS title, o_orderdate::DATE AS announced_on FROM orders WHERE o_orderstatus = 'F')
SELECT {own} AS eli, relation, {other} AS other_eli, title, announced_on, row_number() OVER (PARTITION BY {own} ORDER BY announced_on DESC NULLS LAST, {other}, relation) AS place FROM edges LEFT JOIN acts ON e = {other}"""


CITATIONS_OUT, CITATIONS_IN = _citations_sql("from_eli", "to_eli"), _citations_sql("to_eli", "from_eli")


def source_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order line of each part as the draft that became it."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("act_id"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("draft_id"))
    return op.source_drafts(li)


SOURCE_DRAFTS = "SELECT l_partkey AS act_id, l_orderkey * 10 + l_linenumber AS draft_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) = 1"


def act_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards in figures: days to force, citations each way, newest of them, identifiers, draft."""
    held = _cited_acts(spark, sf_dir).withColumn("in_force_from", F.date_add("announced_on", F.length("title")))
    names = held.select("act_id", F.lit("eli").alias("scheme"), F.col("eli").alias("value"))
    linked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("act_id"), F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("draft_id"))
    cards = op.act_cards(held, names, _edges(spark, sf_dir), linked)
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    return cards.select("eli", F.col("vacatio_days").cast("long").alias("vacatio_days"), F.greatest(n("cites"), F.lit(0)).alias("cites"), F.greatest(n("cited_by"), F.lit(0)).alias("cited_by"), F.get("cites", F.lit(0))["other_eli"].alias("newest_cited"), F.get("identifiers", F.lit(0))["value"].alias("identifier"), "source_draft")


ACT_CARDS = f"""WITH {_EDGES_SQL}, acts AS (SELECT o_orderkey AS act_id, o_orderpriority AS p, 'DU/2024/' || o_orderkey AS e, o_orderdate::DATE AS announced_on FROM orders WHERE o_orderstatus = 'F'),
outs AS (SELECT from_eli, count(*) AS n, first(to_eli ORDER BY announced_on DESC NULLS LAST, to_eli, relation) AS newest FROM edges LEFT JOIN acts ON e = to_eli GROUP BY 1),
ins AS (SELECT to_eli, count(*) AS n FROM edges GROUP BY 1),
src AS (SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) = 1)
SELECT e AS eli, length(p)::BIGINT AS vacatio_days, coalesce(outs.n, 0) AS cites, coalesce(ins.n, 0) AS cited_by, newest AS newest_cited, e AS identifier, l_partkey AS source_draft
FROM acts LEFT JOIN outs ON from_eli = e LEFT JOIN ins ON to_eli = e LEFT JOIN src ON l_orderkey = act_id"""

def draft_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of drafts in figures: where they stand, their history's length, its first and last stage."""
    told = history(spark, sf_dir)
    cards = op.draft_cards(drafts(spark, sf_dir).select("draft_id", "initiator"), _status(spark, sf_dir).select("draft_id", "initiator", "current_stage", "stalled_since"), told)
    n = F.coalesce(F.size("history"), F.lit(0)).cast("long")
    return cards.select("draft_id", "initiator", "current_stage", stamp("stalled_since"), F.greatest(n, F.lit(0).cast("long")).alias("periods"), F.get("history", F.lit(0))["stage"].alias("first_stage"), F.get("history", F.size("history") - 1)["stage"].alias("last_stage"))


DRAFT_CARDS = f"""{_STATUS_WITH}, h AS (SELECT draft_id, count(*) AS n, first(stage ORDER BY valid_from, ordinal) AS f, first(stage ORDER BY valid_from DESC, ordinal DESC) AS l FROM timeline GROUP BY 1)
SELECT d.draft_id, d.initiator, current_stage, {sql_stamp('stalled_since')}, coalesce(n, 0) AS periods, f AS first_stage, l AS last_stage FROM drafts d LEFT JOIN told t ON t.draft_id = d.draft_id LEFT JOIN h ON h.draft_id = d.draft_id"""

QUERIES = {f.__name__: f for f in (kept_stage_pace, as_of_asks, draft_cards, stage_timeline, stage_exceptions, current_stage, stage_pace, shipping_pace, stage_pace_fallback, draft_status, status_counts, as_of_stage, draft_left_act, edge_orientation, citations_out, citations_in, source_drafts, act_cards)}
ORACLES = {
    "kept_stage_pace": STAGE_PACE,
    "as_of_asks": AS_OF_ASKS,
    "draft_cards": DRAFT_CARDS,
    "stage_timeline": STAGE_TIMELINE,
    "stage_exceptions": STAGE_EXCEPTIONS,
    "current_stage": CURRENT_STAGE,
    "stage_pace": STAGE_PACE,
    "shipping_pace": SHIPPING_PACE,
    "stage_pace_fallback": STAGE_PACE_FALLBACK,
    "draft_status": DRAFT_STATUS,
    "status_counts": STATUS_COUNTS,
    "as_of_stage": AS_OF_STAGE,
    "draft_left_act": DRAFT_LEFT_ACT,
    "edge_orientation": EDGE_ORIENTATION,
    "citations_out": CITATIONS_OUT,
    "citations_in": CITATIONS_IN,
    "source_drafts": SOURCE_DRAFTS,
    "act_cards": ACT_CARDS,
}
