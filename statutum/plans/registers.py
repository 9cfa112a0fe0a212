"""Registers as JSON and HTML, made of the supplied tables and read by the engine's readers; counts over what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fetching
from ..functions.text import stems
from ..operators import alerts, legislative, matching, paging, writes
from ..sources import gazette, government, parliament
from .search import STEMS
from .tables import table


def _act_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payloads of acts that refer to the parts of their lines; urgent ones have no sound address."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("DU/2020/"), F.col("l_partkey").cast("string"))).alias("targets"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    eli = F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "du/").otherwise("DU/"), F.lit("2024/"), F.col("o_orderkey").cast("string"))
    refs = F.create_map(F.when(F.col("o_orderstatus") == "F", "Akty zmienione").when(F.col("o_orderstatus") == "O", "Akty wykonawcze").otherwise("Inne"), F.transform(F.coalesce("targets", F.array().cast("array<string>")), lambda t: F.struct(t.alias("id"))))
    payload = F.to_json(F.struct(eli.alias("ELI"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("promulgation"), F.array(F.struct(F.lit(10).alias("term"), F.col("o_custkey").cast("string").alias("number"))).alias("prints"), refs.alias("references")))
    return o.select(eli.alias("external_id"), payload.alias("payload"))


def act_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = gazette.parsed_acts(_act_documents(spark, sf_dir))
    return a.select("eli", "title", "act_type", "announced_on", F.col("prints")[0].alias("print"), F.size(F.map_values("references")[0]).cast("long").alias("references"))


ACT_READER = """SELECT 'DU/2024/' || o_orderkey AS eli, o_orderpriority AS title, CASE WHEN o_orderstatus = 'P' THEN 'nieokreślony' ELSE o_orderstatus END AS act_type, o_orderdate::DATE AS announced_on, 'term10/print/' || o_custkey AS print,
(SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS "references" FROM orders WHERE o_orderpriority <> '1-URGENT'"""


def act_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legislative.orient_edges(gazette.references(gazette.parsed_acts(_act_documents(spark, sf_dir))))


ACT_EDGES = """WITH r AS (SELECT DISTINCT 'DU/2024/' || o_orderkey AS e, 'DU/2020/' || l_partkey AS t, o_orderstatus AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT')
SELECT e AS from_eli, t AS to_eli, 'amends' AS relation FROM r WHERE s = 'F' UNION ALL SELECT t, e, 'implements' FROM r WHERE s = 'O'"""


def unmapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legislative.unmapped_labels(gazette.references(gazette.parsed_acts(_act_documents(spark, sf_dir))))


UNMAPPED_LABELS = "SELECT * FROM (SELECT 'Inne' AS label, count(DISTINCT (l_orderkey, l_partkey)) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'P') WHERE n > 0"


def replaced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders state the parts of their lines, line numbers being versions: the last line's edge stays."""
    li = table(spark, sf_dir, "lineitem")
    eli = lambda c: F.concat(F.lit("DU/2024/"), F.col(c).cast("string"))
    return writes.replace_edges(li.select(eli("l_orderkey").alias("stated_by"), F.col("l_linenumber").alias("version_no"), eli("l_orderkey").alias("from_eli"), eli("l_partkey").alias("to_eli"), F.lit("amends").alias("relation")))


REPLACED_EDGES = """SELECT DISTINCT 'DU/2024/' || l_orderkey AS from_eli, 'DU/2024/' || l_partkey AS to_eli, 'amends' AS relation FROM (SELECT * FROM lineitem QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey)) WHERE l_orderkey <> l_partkey"""


def search_page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as search pages of their orders: sound items and warnings."""
    d = _act_documents(spark, sf_dir).join(table(spark, sf_dir, "orders").select((F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "du/").otherwise("DU/"), F.lit("2024/"), F.col("o_orderkey").cast("string"))).alias("external_id"), "o_custkey"), "external_id")
    pages = d.groupBy(F.col("o_custkey").alias("page_id")).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("totalCount"), F.collect_list("payload").alias("items"))).alias("body"))
    sound, warned = gazette.page_items(pages)
    return sound.select("page_id", F.lit("act").alias("what")).unionByName(warned.select("page_id", F.lit("warning").alias("what"))).groupBy("page_id", "what").agg(F.count(F.lit(1)).alias("n"))


SEARCH_PAGE_ITEMS = "SELECT o_custkey AS page_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'warning' ELSE 'act' END AS what, count(*) AS n FROM orders GROUP BY 1, 2"


def publisher_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as publishers, orders as the changes of their first page: which are read on, newest change, whether all answered."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("publisher"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("changed_at"), (F.col("o_orderstatus") != "x").alias("completed"))
    passes = gazette.publishers_to_read(o, F.lit("1998-07-01"))
    return gazette.next_cursor(passes, F.lit("1998-01-01"), F.lit("1998-07-01"), F.lit("1998-09-01"))


PUBLISHER_CURSOR = """WITH p AS (SELECT o_orderpriority, max(strftime(o_orderdate, '%Y-%m-%d')) AS m FROM orders GROUP BY 1)
SELECT '1998-09-01' AS published_through, greatest(max(m), '1998-07-01') AS last_change, NOT bool_or(m > '1998-07-01') AS source_unchanged FROM p"""


def lookback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts published since a fortnight before the cursor."""
    a = gazette.parsed_acts(_act_documents(spark, sf_dir))
    return gazette.published_window(a, F.lit("1998-07-15").cast("date")).select("eli")


LOOKBACK_WINDOW = "SELECT 'DU/2024/' || o_orderkey AS eli FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderdate::DATE >= DATE '1998-07-01'"


def backfill_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as publishers, years of their customers' orders as partitions of a window."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = o.groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(F.collect_set(F.year("o_orderdate")).alias("years"))
    return gazette.partitions(years, F.lit("1993-05-01").cast("date"), F.lit("1996-01-01").cast("date")).withColumn("year", F.col("year").cast("long"))


BACKFILL_PARTITIONS = "SELECT DISTINCT c_nationkey::VARCHAR AS code, year(o_orderdate)::BIGINT AS year FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) BETWEEN 1993 AND 1996"


def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as project pages with their orders as stages, written as HTML and parsed."""
    state = F.when(F.col("o_orderstatus") == "F", "cbp_tmlabel").when(F.col("o_orderstatus") == "O", "cbp_tmlabel_active").otherwise("cbp_tmlabel_notstart")
    item = F.concat(F.lit('<li id="'), F.col("o_orderkey").cast("string"), F.lit('"><div class="'), state, F.lit('"><a href="/projekt/'), F.col("o_custkey").cast("string"), F.lit("/katalog/"), F.col("o_orderkey").cast("string"), F.lit('">2. Etap</a><div class="small2">Data ostatniej modyfikacji: '), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("</div></div></li>"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(item), "").alias("items"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    html = F.concat(F.lit('<div class="projectTitle"><p class="rcl-title">Projekt &amp; '), "c_name", F.lit('</p></div><div class="info"><div class="row"><div class="col-xs-4">Kadencja sejmu:</div><div class="col-xs-6">IX,</div></div></div><ul class="cbp_tmtimeline">'), "items", F.lit("</ul>"))
    cards = government.project_cards(c.select(html.alias("html")))
    newest = F.array_max(F.transform("stages", lambda s: s["last_modified_on"]))
    return cards.select("project_id", "title", F.col("term").cast("long").alias("term"), F.size("stages").cast("long").alias("stages"), F.size(F.filter("stages", lambda s: s["state"] == "done")).cast("long").alias("done"), newest.alias("touched_on"))


HTML_CARDS = "SELECT o_custkey::VARCHAR AS project_id, 'Projekt & ' || any_value(c_name) AS title, 9::BIGINT AS term, count(*) AS stages, count(*) FILTER (o_orderstatus = 'F') AS done, max(o_orderdate)::DATE AS touched_on FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"


def linkage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as prints, open ones as acts; lines as identifiers, returned ones of prints."""
    d = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "print").when(F.col("o_orderstatus") == "O", "act").otherwise("club").alias("kind"))
    i = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "druk_sejmowy").otherwise("eli").alias("scheme"))
    return legislative.linkage(d, i).select("scheme", "matchable", "linked", F.round("ratio", 6).alias("ratio"))


LINKAGE_RATIO = """WITH d AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'druk_sejmowy' ELSE 'eli' END AS scheme, count(*) AS matchable FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
i AS (SELECT CASE l_returnflag WHEN 'R' THEN 'druk_sejmowy' ELSE 'eli' END AS scheme, count(*) AS linked FROM lineitem GROUP BY 1) SELECT scheme, matchable, coalesce(linked, 0) AS linked, round(coalesce(linked, 0) / matchable, 6) AS ratio FROM d LEFT JOIN i USING (scheme)"""


def unmatched_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as prints; those with a returned line are pinned."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("external_id"), F.lit("print").alias("kind"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"))
    i = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lit("druk_sejmowy").alias("scheme"), F.col("l_orderkey").cast("string").alias("value"))
    return matching.unmatched_prints(d, i)


UNMATCHED_PRINTS = "SELECT o_orderkey::VARCHAR AS external_id, 'print' AS kind, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def match_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as prints, lines as their matches: discounts of 0.08 and more are taken, of 0.05 and more reviewed."""
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("print_id")).agg(F.max("l_discount").alias("d"))
    found = best.where("d >= 0.05").select("print_id", F.when(F.col("d") >= 0.08, "fuzzy").otherwise("review").alias("decision"))
    return matching.match_outcomes(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("print_id")), found)


MATCH_OUTCOMES = """WITH b AS (SELECT l_orderkey, max(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT CASE WHEN d >= 0.08 THEN 'automatic' WHEN d >= 0.05 THEN 'review' ELSE 'none' END AS outcome, count(*) AS n FROM orders LEFT JOIN b ON l_orderkey = o_orderkey GROUP BY 1"""


def delivery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    return alerts.delivery_counts(d, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("reason")))


DELIVERY_COUNTS = "SELECT 'delivery' AS what, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'suppression', c_mktsegment, count(*) FROM customer GROUP BY 2"


def declared_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three registers say they hold: nations as terms with their customers as prints, suppliers' years of lines as publishers' acts, priorities as project types."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("term")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("c_acctbal") < 0).alias("n"))
    terms = c.select("term", F.struct("count").alias("prints"))
    listed = c.select("term", F.lit("proceeding").alias("kind"), "n")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("code"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("total_count"))
    o = table(spark, sf_dir, "orders").groupBy(F.lower("o_orderpriority").alias("list_type")).agg(F.count(F.lit(1)).alias("total_count"))
    return parliament.declared_volumes(terms, listed).unionByName(gazette.declared_volumes(li)).unionByName(government.declared_volumes(o))


DECLARED_VOLUMES = """WITH c AS (SELECT 'term' || c_nationkey AS p, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS k FROM customer GROUP BY 1)
SELECT 'sejm' AS source, p AS partition, 'print' AS kind, p || '/print/' AS prefix, n AS declared, TRUE AS authoritative FROM c UNION ALL SELECT 'sejm', p, 'proceeding', p || '/proceeding/', k, FALSE FROM c
UNION ALL SELECT 'isap', l_suppkey || '/' || year(l_shipdate), 'act', l_suppkey || '/' || year(l_shipdate) || '/', count(*), TRUE FROM lineitem GROUP BY l_suppkey, year(l_shipdate)
UNION ALL SELECT 'rcl', lower(o_orderpriority), 'project', 'projekt/' || lower(o_orderpriority) || '/', count(*), TRUE FROM orders GROUP BY o_orderpriority"""


def stem_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as keywords: every distinct name is stemmed once and joined back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("keyword").alias("kind"), F.col("p_name").alias("value"))
    once = p.select("value").distinct().withColumn("stems", stems(F.col("value")))
    return matching.with_stems(p, once).select("p_partkey", F.array_join("stems", " ").alias("stems"))


STEM_MEMO = f"SELECT p_partkey, array_to_string({STEMS.format('p_name')}, ' ') AS stems FROM part"


def profile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles of version 1, orders' keys as revisions."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.lit(1).cast("long").alias("current_version"))
    return paging.profile_versions(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("version")))


PROFILE_VERSIONS = "SELECT c_custkey AS profile_id, greatest(1, coalesce(m, 0))::BIGINT AS current_version FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey"


def dropped_proceedings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as proceedings of their supplier's term; those that a whole discount numbers 0 go."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("term"), F.col("l_suppkey").cast("string"), F.lit("/proceeding/"), F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("external_id"))
    return writes.drop_unnumbered_proceedings(li).groupBy("external_id").agg(F.count(F.lit(1)).alias("n"))


DROPPED_PROCEEDINGS = "SELECT 'term' || l_suppkey || '/proceeding/' || round(l_discount * 100)::INT AS external_id, count(*) AS n FROM lineitem WHERE round(l_discount * 100) <> 0 GROUP BY 1"


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches: what became of them, and whether they are tried again."""
    status = F.element_at(F.array(*map(F.lit, (200, 304, 404, 429, 503))), (F.col("user_id") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events").withColumn("s", status)
    outcome = fetching.fetch_outcome(F.col("s"), F.col("event_type") != "error", F.col("event_type") == "signup")
    return e.select(outcome.alias("outcome"), fetching.may_retry(F.col("s"), (F.col("event_id") % 6).cast("int")).alias("again")).groupBy("outcome", "again").agg(F.count(F.lit(1)).alias("n"))


FETCH_OUTCOMES = """WITH e AS (SELECT *, [200, 304, 404, 429, 503][(user_id % 5 + 1)::BIGINT] AS s FROM events)
SELECT CASE WHEN event_type = 'error' OR (event_type = 'signup' AND s = 200) THEN 'refused' WHEN s = 304 THEN 'not_modified' WHEN s = 200 THEN 'fetched' ELSE 'failed' END AS outcome, s IN (429, 503) AND event_id % 6 < 4 AS again, count(*) AS n FROM e GROUP BY 1, 2"""



def paced_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, users' thirds as hosts, a request in ten minutes of each: when each is sent."""
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(3)).cast("string").alias("host"), F.col("event_id").alias("request"), F.to_utc_timestamp("ts", "UTC").alias("asked_at"), F.lit(1 / 600).alias("per_second"))
    return fetching.paced(e).select("host", "request", F.unix_micros("sent_at").alias("sent_us"))


PACED_FETCHES = """WITH e AS (SELECT (user_id % 3)::VARCHAR AS host, event_id AS request, epoch_us(ts) AS asked, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS k FROM events)
SELECT host, request, max(asked - k * 600000000) OVER (PARTITION BY host ORDER BY k) + k * 600000000 AS sent_us FROM e"""

QUERIES = {
    f.__name__: f
    for f in (act_reader, act_edges, unmapped_labels, replaced_edges, search_page_items, publisher_cursor, lookback_window, backfill_partitions, html_cards, linkage_ratio, unmatched_prints, match_outcomes, delivery_counts, declared_volumes, stem_memo, profile_versions, dropped_proceedings, fetch_outcomes, paced_fetches)
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
