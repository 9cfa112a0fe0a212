"""How the supplied tables stand in for the engine's own: which column plays which part. Each role has its SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of every query.
NOW = "2024-02-15 12:00:00"
#: Moves that event types allow, the type that counts as unknown, and the one expected next.
MOVES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view")]
UNKNOWN = "error"
NEXT = {"signup": "view", "view": "click", "click": "purchase"}
STAMP = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def stamp(c: str) -> Column:
    """A time as text, so that results do not depend on zones."""
    return F.date_format(c, STAMP).alias(c)


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as drafts, event types as stages."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("draft_id"), F.col("event_id").alias("ordinal"), F.to_date("ts").alias("day"), F.col("event_type").alias("stage"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline rows as stated: each is known two days after it began."""
    from ..operators.legislative import stage_timeline

    return stage_timeline(stages(spark, sf_dir)).withColumn("known_at", F.timestamp_add("DAY", F.lit(2), F.col("valid_from")))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as drafts: segment as initiator, first order as act, closed where the balance is negative."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("act_id"))
    c = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("draft_id"), F.col("c_mktsegment").alias("initiator"), "act_id", F.when(F.col("c_acctbal") < 0, F.lit("2024-01-20").cast("timestamp")).alias("closed_at"))


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("act_id"), F.to_date("o_orderdate").alias("in_force_from"))


TIMELINE_SQL = """
stages AS (SELECT user_id AS draft_id, event_id AS ordinal, ts::DATE AS day, event_type AS stage FROM events),
led AS (SELECT *, lead(day) OVER (PARTITION BY draft_id ORDER BY day, ordinal) AS following FROM stages WHERE day IS NOT NULL),
timeline AS (SELECT draft_id, ordinal, coalesce(stage, 'nieznany') AS stage, day::TIMESTAMP AS valid_from,
  CASE WHEN following IS NOT NULL THEN greatest(following, day + 1)::TIMESTAMP END AS valid_to FROM led)"""

DRAFTS_SQL = """
drafts AS (SELECT c_custkey AS draft_id, c_mktsegment AS initiator, act_id, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-20' END AS closed_at
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS act_id FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""

STAYS_SQL = """
stays AS (SELECT initiator, stage, date_diff('second', valid_from, valid_to) AS seconds FROM timeline JOIN drafts USING (draft_id) WHERE valid_to IS NOT NULL),
own AS (SELECT initiator, stage, floor(quantile_cont(seconds, 0.5))::BIGINT AS m, count(*) AS n FROM stays GROUP BY ALL),
everyone AS (SELECT stage, floor(quantile_cont(seconds, 0.5))::BIGINT AS m, count(*) AS n FROM stays GROUP BY ALL)"""

CURRENT_SQL = """
current AS (SELECT draft_id, stage, valid_from AS since, ordinal FROM timeline
  QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY valid_from DESC, ordinal DESC) = 1)"""


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
