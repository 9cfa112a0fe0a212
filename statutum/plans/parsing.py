"""Parsing and classification over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, vocabulary
from ..functions.text import normalise_title
from ..operators import legislative
from ..operators.writes import roles_by_user, roles_of
from ..sources import government, parliament
from .tables import table


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"))


JSON_EXTRACT = "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"


def date_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in four forms, one of which is no date."""
    o = table(spark, sf_dir, "orders")
    form = (
        F.when(F.col("o_orderpriority").startswith("1"), F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderpriority").startswith("2"), F.date_format("o_orderdate", "dd-MM-yyyy"))
        .when(F.col("o_orderpriority").startswith("3"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
        .when(F.col("o_orderpriority").startswith("4"), F.lit("31-02-1998"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return o.select("o_orderkey", dates.tolerant_date(form).alias("day"))


DATE_TOLERANT = "SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderdate::DATE END AS day FROM orders"


def title_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(normalise_title(F.col("text")), F.lit("")), 256).alias("normalised_sha256"))


TITLE_NORMALISE = r"""SELECT doc_id, sha256(coalesce(trim(regexp_replace(replace(strip_accents(lower(text)), 'ł', 'l'), '[^\p{L}\p{N}]+', ' ', 'g')), '')) AS normalised_sha256 FROM documents"""


def classify_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as addresses of six shapes, classified and counted."""
    li = table(spark, sf_dir, "lineitem")
    term = F.concat(F.lit("term"), F.col("l_suppkey").cast("string"))
    k = F.col("l_partkey").cast("string")
    shapes = [
        F.concat_ws("/", term, F.lit("print"), k),
        F.concat_ws("/", term, F.lit("proceeding"), k, F.lit("voting"), k),
        F.concat_ws("/", term, F.lit("proceeding"), F.date_format("l_shipdate", "yyyy-MM-dd")),
        F.concat_ws("/", term, F.lit("process"), k),
        F.concat_ws("/", F.lit("projekt/ustawy"), k, F.lit("katalog"), k),
        F.concat_ws("/", F.lit("DU/2024"), k),
        F.concat_ws("/", term, F.lit("interpellation"), k),
    ]
    address = F.element_at(F.array(*shapes), F.col("l_linenumber"))
    rows = li.select(vocabulary.parliament_kind(address).alias("parliament"), vocabulary.government_kind(address).alias("government"), vocabulary.gazette_kind(address).alias("gazette"), ids.publisher_of(address).alias("publisher"))
    return rows.groupBy("parliament", "government", "gazette", "publisher").agg(F.count(F.lit(1)).alias("n"))


CLASSIFY_ADDRESSES = """WITH c AS (SELECT ['print', 'voting', 'proceeding', 'process', 'unknown', 'unknown', 'unknown'][l_linenumber::BIGINT] AS parliament,
CASE l_linenumber WHEN 5 THEN 'rcl-catalog' ELSE 'unknown' END AS government, CASE l_linenumber WHEN 6 THEN 'act' ELSE 'unknown' END AS gazette, CASE l_linenumber WHEN 6 THEN 'DU' END AS publisher FROM lineitem)
SELECT *, count(*) AS n FROM c GROUP BY ALL"""


def process_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as processes, read from JSON made of them: initiator, outcome and stages."""
    o = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_orderstatus") == "F", "Rządowy projekt").when(F.col("o_orderstatus") == "O", "Przedstawiony przez Prezydium Sejmu projekt").otherwise("Uchwała")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    ended = F.when(F.col("o_orderpriority").startswith("1"), "Uchwalono").when(F.col("o_orderpriority").startswith("2"), "Wycofano projekt")
    stage = lambda kind, name, when: F.struct(when.alias("date"), name.alias("stageName"), F.lit(kind).alias("stageType"))
    payload = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("number"),
            F.lit(10).alias("term"),
            title.alias("title"),
            F.when(F.col("o_orderpriority").startswith("5"), "CANDIDATE").otherwise("BILL").alias("documentTypeEnum"),
            F.when(~F.col("o_orderpriority").startswith("4"), day).alias("closureDate"),
            (F.col("o_totalprice") > 200000).alias("passed"),
            F.array(stage("Start", F.lit("Wpłynął"), day), stage("SejmReading", F.lit("II czytanie na posiedzeniu"), day), stage("End", F.coalesce(ended, F.lit("Zamknięto")), F.lit(None).cast("string"))).alias("stages"),
        )
    )
    p = parliament.processes(o.select(F.lit("").alias("external_id"), payload.alias("payload")))
    return p.select("address", "initiator", "outcome", "closed_on", F.array_join(F.transform(F.filter("stages", lambda s: s["day"].isNotNull()), lambda s: s["stage"]), ",").alias("stages"))


PROCESS_OUTCOMES = """SELECT 'term10/print/' || o_orderkey AS address, CASE o_orderstatus WHEN 'F' THEN 'rzadowy' WHEN 'O' THEN 'prezydium_sejmu' ELSE 'nieznany' END AS initiator,
CASE WHEN o_orderpriority LIKE '4%' THEN NULL WHEN o_orderpriority LIKE '1%' THEN 'uchwalony' WHEN o_orderpriority LIKE '2%' THEN 'wycofany' WHEN o_totalprice > 200000 THEN 'uchwalony' ELSE 'odrzucony' END AS outcome,
CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderdate::DATE END AS closed_on, 'wplynal_do_sejmu,ii_czytanie' AS stages FROM orders WHERE o_orderpriority NOT LIKE '5%'"""


def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes made of orders, two stages each, as drafts with the facts that they state."""
    o = table(spark, sf_dir, "orders")
    first, second = F.to_date("o_orderdate"), F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 9).cast("int")))
    stage = lambda n, day, name: F.struct(F.lit(n).alias("ordinal"), day.alias("day"), F.lit(name).alias("stage"))
    parsed = o.select(F.concat(F.lit("term10/print/"), F.col("o_orderkey").cast("string")).alias("address"), F.lit("t").alias("title"), F.col("o_orderstatus").alias("initiator"), first.alias("started_on"), F.when(F.col("o_orderstatus") == "F", second).alias("closed_on"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("eli"), F.array(stage(0, first, "wplynal_do_sejmu"), stage(1, second, "i_czytanie")).alias("stages"))
    facts = legislative.stage_facts(parsed, F.lit("2024-01-01").cast("timestamp"))
    named = legislative.drafts_of(parsed).join(facts, "draft_id")
    return named.select("address", F.col("ordinal").cast("long").alias("ordinal"), "stage", F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), F.to_date("closed_at").alias("closed_on"))


STATED_FACTS = """WITH o AS (SELECT 'term10/print/' || o_orderkey AS address, o_orderdate::DATE AS a, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + (o_orderkey % 9)::INT END AS b, o_orderstatus AS s FROM orders)
SELECT address, 0::BIGINT AS ordinal, 'wplynal_do_sejmu' AS stage, a AS valid_from, CASE WHEN b IS NOT NULL THEN greatest(b, a + 1) END AS valid_to, CASE WHEN s = 'F' THEN b END AS closed_on FROM o
UNION ALL SELECT address, 1, 'i_czytanie', b, NULL, CASE WHEN s = 'F' THEN b END FROM o WHERE b IS NOT NULL"""


def stated_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parsed acts, those that are pending without an address: acts, with the number of identifiers that each gets (its address and its prints, once each)."""
    o = table(spark, sf_dir, "orders")
    eli = F.when(F.col("o_orderstatus") != "P", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "DU").otherwise("MP"), F.lit("/2024/"), F.col("o_orderkey").cast("string")))
    prints = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int")), lambda k: F.concat(F.lit("term10/print/"), F.floor((F.col("o_orderkey") + k) / 2).cast("string")))
    parsed = o.select(eli.alias("eli"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("act_type"), F.to_date("o_orderdate").alias("announced_on"), F.lit(None).cast("date").alias("in_force_from"), prints.alias("prints"))
    named = legislative.act_identifiers(parsed).groupBy("act_id").agg(F.count(F.lit(1)).alias("identifiers"))
    return legislative.acts_of(parsed).join(named, "act_id").select("eli", "title", "act_type", "publisher", "announced_on", "identifiers")


STATED_ACTS = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'DU' ELSE 'MP' END || '/2024/' || o_orderkey AS eli, o_orderpriority AS title, o_orderstatus AS act_type, CASE WHEN o_orderkey % 2 = 0 THEN 'DU' ELSE 'MP' END AS publisher, o_orderdate::DATE AS announced_on,
1 + len(list_distinct(list_transform(range(0, o_orderkey % 4 + 1), lambda k: (o_orderkey + k) // 2))) AS identifiers FROM orders WHERE o_orderstatus <> 'P'"""


def card_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as project cards, those of low priority without a date: the facts that they state, counted by day."""
    cards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("project_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.to_date("o_orderdate")).alias("created_on"))
    facts = legislative.government_facts(cards, F.lit("2024-01-01").cast("timestamp"))
    return facts.where("valid_to is null and not exception").groupBy("stage", F.col("ordinal").cast("long").alias("ordinal"), F.to_date("valid_from").alias("valid_from")).agg(F.countDistinct("draft_id").alias("drafts"))


CARD_FACTS = "SELECT 'proces_rzadowy' AS stage, 0::BIGINT AS ordinal, o_orderdate::DATE AS valid_from, count(*) AS drafts FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 3"


def register_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists that a change register's lines give: moves between stages, catalogs below, documents filed."""
    changes = _register_changes(spark, sf_dir)
    parts = [(n, f(changes)) for n, f in (("transition", government.stage_transitions), ("catalog", government.child_catalogs), ("document", government.documents_filed))]
    rows = [part.select(F.lit(n).alias("list"), "event_id", F.coalesce("new_value", "catalog_name", "document_name").alias("what")) for n, part in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


REGISTER_LISTS = """SELECT 'transition' AS list, event_id, user_id::VARCHAR AS what FROM events WHERE event_type = 'view' UNION ALL SELECT 'catalog', event_id, user_id::VARCHAR FROM events WHERE event_type = 'click'
UNION ALL SELECT 'document', event_id, user_id || '.pdf' FROM events WHERE event_type = 'purchase'"""


def registers_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as terms of which those of five nations are current, their last order as the time of change: which are read again."""
    last = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("lastChanged"))
    terms = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("term"), (F.col("c_nationkey") < 5).alias("current"), F.struct("lastChanged").alias("prints"))
    return parliament.registers_changed(terms, F.lit("1998-07-01")).select("term", F.col("prints.lastChanged").alias("changed"))


REGISTERS_CHANGED = """WITH t AS (SELECT c_custkey AS term, strftime(max(o_orderdate), '%Y-%m-%d') AS changed FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' WHERE c_nationkey < 5 GROUP BY 1)
SELECT * FROM t WHERE changed IS DISTINCT FROM '1998-07-01'"""


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages and the number of links in them, by patterns on the whole page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1).alias("title"), F.coalesce(F.regexp_count("html", F.lit("<a href=")), F.lit(0)).cast("long").alias("links"))


HTML_TITLES = "SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(coalesce(html, ''), '<a href='))::BIGINT AS links FROM pages"


def _register_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a change register in the register's wording, classified."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id").cast("string")
    said = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Zmieniono atrybut projektu nazwa etapu na: "), k))
        .when(F.col("event_type") == "click", F.concat(F.lit("Dodano katalog  "), k))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Dodano dokument "), k, F.lit(".pdf")))
        .when(F.col("event_type") == "signup", F.lit("Stworzono projekt"))
        .otherwise("Coś innego")
    )
    rows = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.lit("x").alias("author"), said.alias("description"), F.concat(F.lit("/projekt/1/katalog/"), k).alias("href"))
    return government.classified_changes(rows)


def register_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _register_changes(spark, sf_dir).select("event_id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm").alias("occurred_at"), "kind", "attribute", "new_value", "catalog_name", "document_name", "catalog_id")


REGISTER_EVENTS = """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS occurred_at,
CASE event_type WHEN 'view' THEN 'attribute_changed' WHEN 'click' THEN 'catalog_added' WHEN 'purchase' THEN 'document_added' WHEN 'signup' THEN 'project_created' ELSE 'other' END AS kind,
CASE event_type WHEN 'view' THEN 'nazwa etapu' END AS attribute, CASE event_type WHEN 'view' THEN user_id::VARCHAR END AS new_value,
CASE event_type WHEN 'click' THEN user_id::VARCHAR END AS catalog_name, CASE event_type WHEN 'purchase' THEN user_id || '.pdf' END AS document_name, user_id::VARCHAR AS catalog_id FROM events"""


def listing_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority as listings, newest first, ten to a page, but for those of status P, which stand by number: what a walk since a day visits.

    A walk stops after the first page with an older entry, so entries behind it are not visited however new they are.
    """
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("list_type"), F.col("o_orderkey").alias("project_id"), F.to_date("o_orderdate").alias("modified_on"))
    newest = F.when(~F.col("list_type").endswith("/P"), F.col("modified_on"))
    place = F.row_number().over(Window.partitionBy("list_type").orderBy(newest.desc_nulls_last(), "project_id")) - 1
    entries = o.withColumn("place", place).withColumn("page", F.floor(F.col("place") / 10) + 1)
    return government.changed_entries(entries, F.lit("1998-06-01").cast("date")).select("list_type", "project_id", "modified_on")


LISTING_WALK = """WITH o AS (SELECT o_orderpriority || '/' || o_orderstatus AS list_type, o_orderkey AS project_id, o_orderdate::DATE AS modified_on, o_orderstatus AS s FROM orders),
p AS (SELECT *, (row_number() OVER (PARTITION BY list_type ORDER BY CASE WHEN s <> 'P' THEN modified_on END DESC NULLS LAST, project_id) - 1) // 10 AS page FROM o)
SELECT list_type, project_id, modified_on FROM p WHERE modified_on >= DATE '1998-06-01'
AND NOT EXISTS (SELECT 1 FROM p x WHERE x.list_type = p.list_type AND x.page < p.page AND x.modified_on < DATE '1998-06-01')"""


def catalog_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects, their orders as stages, parts as catalogs below them: what two levels reach."""
    o = table(spark, sf_dir, "orders")
    stages = o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("catalog_id"), (F.col("o_orderstatus") != "P").alias("visitable"), F.to_date("o_orderdate").alias("last_modified_on"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_partkey").alias("catalog_id")).distinct()
    return government.reachable_catalogs(stages, children, F.lit("1998-06-01").cast("date")).withColumn("level", F.col("level").cast("long"))


CATALOG_WALK = """WITH s AS (SELECT DISTINCT o_custkey AS project_id, o_orderkey AS catalog_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate::DATE >= DATE '1998-06-01'),
k AS (SELECT DISTINCT l_orderkey AS parent_id, l_partkey AS catalog_id FROM lineitem),
b AS (SELECT DISTINCT project_id, k.catalog_id FROM s JOIN k ON parent_id = s.catalog_id)
SELECT *, 1::BIGINT AS level FROM s UNION ALL SELECT *, 2::BIGINT FROM (FROM b EXCEPT FROM s)"""


def changed_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a high-water mark, and undated ones; with the mark that follows."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("changed_at"))
    mark = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    after = parliament.next_watermark(rows, "changed_at", mark)
    return parliament.changed_since(rows, "changed_at", mark).crossJoin(F.broadcast(after)).select("event_id", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark"))


CHANGED_PROCESSES = """WITH r AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS c FROM events)
SELECT event_id, (SELECT strftime(greatest(max(c), TIMESTAMP '2024-01-25'), '%Y-%m-%d %H:%M:%S') FROM r) AS watermark FROM r WHERE c IS NULL OR c > TIMESTAMP '2024-01-25'"""


def backfill_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five orders of each customer after order 1000, and whether any are left."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return parliament.backfill_chunk(o, "o_custkey", "o_orderkey", F.lit(1000), 5)


BACKFILL_CHUNK = "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) <= 5 AS done FROM orders WHERE o_orderkey > 1000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5"


def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' first to last order as terms; those without a second order are open."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e"))
    end = F.when(F.col("e") > F.col("s"), F.col("e"))
    return o.select("o_custkey", dates.overlaps(F.col("s"), end, F.lit("1993-01-01").cast("date"), F.lit("1993-06-30").cast("date")).alias("overlaps"))


TERM_OVERLAP = """SELECT o_custkey, min(o_orderdate)::DATE <= DATE '1993-06-30' AND (CASE WHEN max(o_orderdate) > min(o_orderdate) THEN max(o_orderdate)::DATE ELSE DATE '9999-12-31' END) >= DATE '1993-01-01' AS overlaps FROM orders GROUP BY 1"""


def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), ids.voting_address(F.col("l_suppkey"), k, F.col("l_linenumber")).alias("voting"), ids.project_address("ustawy", k, F.col("l_suppkey"), register=True).alias("register"), ids.eli(F.lit("DU"), F.year("l_shipdate"), k).alias("eli"))


EXTERNAL_IDS = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'term' || l_suppkey || '/proceeding/' || l_partkey || '/voting/' || l_linenumber AS voting, 'projekt/ustawy/' || l_partkey || '/katalog/' || l_suppkey || '/rejestr' AS register, 'DU/' || year(l_shipdate) || '/' || l_partkey AS eli FROM lineitem"


def roman_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeral = F.element_at(F.array(*map(F.lit, ("i", "IV", " ix ", "XX", "XXI"))), (F.col("p_size") % 5 + 1).cast("int"))
    parts = dates.comma_list(F.concat_ws(",", F.replace("p_name", F.lit(" "), F.lit(" , ,")), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", dates.roman_term(numeral).cast("long").alias("term"), F.array_join(parts, "|").alias("parts"))


ROMAN_AND_LISTS = "SELECT p_partkey, [1, 4, 9, 20, NULL][(p_size % 5 + 1)::BIGINT]::BIGINT AS term, replace(p_name, ' ', '|') AS parts FROM part"


def role_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles out of comma-separated lists and back into sorted sets."""
    users = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ,")), F.lit(", ")).alias("roles"))
    return roles_by_user(roles_of(users)).select("user_id", F.array_join("roles", "|").alias("roles"))


ROLE_ROWS = "SELECT p_partkey AS user_id, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS roles FROM part"


def status_from_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 302, 401, 403, 404, 500))), (F.col("user_id") % 6 + 1).cast("int"))
    method = F.when(F.col("event_type") == "view", "GET").otherwise("POST")
    e = table(spark, sf_dir, "events").withColumn("s", status).where(vocabulary.is_recorded(method, F.col("s")))
    return e.select("event_id", vocabulary.audit_outcome(F.col("s")).alias("outcome"))


STATUS_FROM_HTTP = """WITH e AS (SELECT event_id, event_type, [200, 302, 401, 403, 404, 500][(user_id % 6 + 1)::BIGINT] AS s FROM events),
o AS (SELECT *, CASE WHEN s IN (401, 403) THEN 'denied' WHEN s >= 500 THEN 'failed' WHEN s >= 400 THEN 'rejected' ELSE 'succeeded' END AS outcome FROM e)
SELECT event_id, outcome FROM o WHERE NOT (event_type = 'view' AND outcome = 'succeeded')"""


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties with keys in order: equal content, equal hash."""
    from ..functions.json_text import canonical

    nested = F.concat(F.lit('{"b": {"z": 1, "a": [2, 1]}, "a": '), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", canonical(nested).alias("canonical"))


CANONICAL_JSON = """SELECT event_id, '{"a":{"k":' || json_extract(props, '$.k') || '},"b":{"a":[2,1],"z":1}}' AS canonical FROM events"""

QUERIES = {f.__name__: f for f in (stated_facts, stated_acts, card_facts, register_lists, registers_changed, json_extract, date_tolerant, title_normalise, classify_addresses, process_outcomes, html_titles, register_events, listing_walk, catalog_walk, changed_processes, backfill_chunk, term_overlap, external_ids, roman_and_lists, role_rows, status_from_http, canonical_json)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
