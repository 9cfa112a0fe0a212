"""Search over the supplied tables: whole texts of documents as titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENDINGS, LEGAL_FORMS, STOP_WORDS, highlight, holds_all, stems
from ..functions.word_forms import word_forms
from ..operators import analysis, sinks
from ..operators import search as op
from ..storage import materialize, shared_dir, shared_path
from .tables import table

_QUERY = "ention edtion ustawami queque thintion"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("stage"), F.lit(None).cast("string").alias("initiator"), F.lit(None).cast("string").alias("act_type"), F.coalesce("text", F.lit("")).alias("title"), F.lit(None).cast("string").alias("eli"), F.array(F.concat(F.lit("no"), F.col("doc_id").cast("string"))).alias("identifiers")).withColumn("stems", stems(F.col("title")))


def _index(spark: SparkSession, sf_dir: str) -> op.Index:
    """The documents' published index, which all searches of a session share; it is published anew where a file of the table has changed."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select(F.xxhash64("path", "length", "modificationTime").alias("h"))  # no contents are read
    stamp = files.agg(F.bit_xor("h")).first()[0]
    root = f"{shared_dir(spark)}/statutum/indexes-{spark.sparkContext.applicationId}"
    name = f"documents_{stamp & 0xFFFFFFFFFFFFFFFF:016x}"
    try:
        return sinks.live_index(spark, root, name)
    except FileNotFoundError:
        sinks.publish_index(_entries(spark, sf_dir), root, name)
        return sinks.live_index(spark, root, name)


_FORMS = {w: root for root, many in LEGAL_FORMS.items() for w in many.split()}
_STEM = f"coalesce(map {{{', '.join(repr(k) + ': ' + repr(v) for k, v in _FORMS.items())}}}[w], regexp_replace(w, '^(.{{3,}}?)(?:{'|'.join(dict.fromkeys(ENDINGS))})$', '\\1'))"
STEMS = r"list_transform(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains([" + ", ".join(repr(w) for w in STOP_WORDS) + "], w)), lambda w: " + _STEM.replace("{", "{{").replace("}", "}}") + ")"
_SCORED = rf"""e AS (SELECT doc_id, lang, source, {STEMS.format('text')} AS s FROM documents),
q AS (SELECT unnest(list_distinct({STEMS.format("'" + _QUERY + "'")})) AS w),
t AS (SELECT doc_id, len(s) AS l, unnest(s) AS w FROM e),
tf AS (SELECT doc_id, l, w, count(*) AS tf FROM t JOIN q USING (w) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n, avg(len(s)) AS m FROM e WHERE len(s) > 0),
b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) AS score, count(*) AS matched FROM tf JOIN df USING (w), n GROUP BY 1)"""


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents that a search finds."""
    query = spark.range(1).select(F.lit(0).alias("query"), F.array_distinct(stems(F.lit(_QUERY))).alias("wanted"))
    index = _index(spark, sf_dir)
    return op.title_scores(index.entries, query, index).select(F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), "matched")


BM25_SCORES = f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score, matched FROM b"


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty English documents, by title or number."""
    index = _index(spark, sf_dir)
    hits = op.search(index.entries, _QUERY, kinds=("en",), index=index)["hits"]
    return hits.select("id", F.round("score", 6).alias("score"))


BM25_SEARCH = f"WITH {_SCORED} SELECT doc_id::VARCHAR AS id, round(8 * score, 6) AS score FROM b JOIN e USING (doc_id) WHERE lang = 'en' ORDER BY 8 * score DESC, id LIMIT 20"


def published_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search of an index published twice and read through its alias: postings and statistics, no titles."""
    root = shared_path(spark, "indexes")
    for _ in range(2):
        sinks.publish_index(_entries(spark, sf_dir), root)
    live = sinks.live_index(spark, root)
    return op.search(live.entries, _QUERY, kinds=("en",), index=live)["hits"].select("id", F.round("score", 6).alias("score"))


PUBLISHED_SEARCH = BM25_SEARCH


def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return op.search(index.entries, _QUERY, index=index)["facets"]


SEARCH_FACETS = f"""WITH {_SCORED}, f AS (SELECT 'kind' AS field, lang AS value, count(*) AS n FROM b JOIN e USING (doc_id) GROUP BY 2 UNION ALL SELECT 'stage', source, count(*) FROM b JOIN e USING (doc_id) GROUP BY 2)
SELECT * FROM f WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 20"""


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return op.search(index.entries, _QUERY, index=index)["total"]


SEARCH_TOTAL = f"WITH {_SCORED} SELECT count(*) AS total FROM b"


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent values of two columns of orders."""
    return op.facets(table(spark, sf_dir, "orders"), ("o_orderstatus", "o_orderpriority"))


FACETS = """WITH f AS (SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
SELECT * FROM f WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 20"""


def phrase_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text has all words of a phrase, the best ten."""
    words = spark.range(1).select(F.lit("the and of").alias("value"), stems(F.lit("the and of")).alias("wanted"))
    index = _index(spark, sf_dir)
    return op.titles_matching(index.entries, words, 10, index).select("value", F.col("entry_kind").alias("kind"), "id")


PHRASE_AND = f"WITH {_SCORED.replace(_QUERY, 'the and of')} SELECT 'the and of' AS value, lang AS kind, doc_id::VARCHAR AS id FROM b JOIN e USING (doc_id) WHERE matched = (SELECT count(*) FROM q) QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 10"


def browse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a listing without text, filtered."""
    return op.search(_entries(spark, sf_dir), "  ", offset=5, size=30, kinds=("en", "fr"), stages=("src1", "src2"))["hits"].select("id", "kind")


BROWSE_FILTER = "SELECT doc_id::VARCHAR AS id, lang AS kind FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2') ORDER BY id LIMIT 30 OFFSET 5"


def title_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of whole texts, as a digest."""
    return _entries(spark, sf_dir).select("id", F.size("stems").cast("long").alias("n"), F.sha2(F.array_join("stems", " "), 256).alias("stems_sha256"))


TITLE_STEMS = f"SELECT doc_id::VARCHAR AS id, len(s)::BIGINT AS n, sha256(array_to_string(s, ' ')) AS stems_sha256 FROM (SELECT doc_id, {STEMS.format('text')} AS s FROM documents)"


def title_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", highlight(F.col("p_name"), stems(F.lit("small widgets"))).alias("highlight"))


TITLE_HIGHLIGHT = r"SELECT p_partkey, regexp_replace(p_name, '\b(small|widgets)\b', '<em>\1</em>', 'g') AS highlight FROM part"


def stems_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all stems of a keyword."""
    return _entries(spark, sf_dir).where(holds_all(stems(F.lit("ther onen")), F.col("stems"))).select("id")


STEMS_SUBSET = f"SELECT doc_id::VARCHAR AS id FROM documents WHERE list_has_all({STEMS.format('text')}, {STEMS.format(chr(39) + 'ther onen' + chr(39))})"


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as acts and customers as drafts in one table of entries."""
    o = table(spark, sf_dir, "orders")
    acts = o.select(F.col("o_orderkey").cast("string").alias("act_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("DU/"), F.col("o_orderkey").cast("string")).alias("eli"), F.col("o_orderstatus").alias("act_type"), F.lit("DU").alias("publisher"), F.to_date("o_orderdate").alias("announced_on"), F.lit(None).cast("date").alias("in_force_from"))
    c = table(spark, sf_dir, "customer")
    drafts = c.select(F.col("c_custkey").cast("string").alias("draft_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("initiator"), F.col("c_nationkey").alias("term"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("outcome"), F.array("c_name").alias("identifiers"), F.lit(None).cast("date").alias("started_on"))
    e = op.index_entries(acts, drafts)
    return e.select("id", "kind", "title", "eli", "initiator", F.col("identifiers")[0].alias("identifier"), op.own_id(F.col("id")).alias("own_id"))


INDEX_ENTRIES = """SELECT 'act:' || o_orderkey AS id, 'act' AS kind, o_orderpriority AS title, 'DU/' || o_orderkey AS eli, NULL AS initiator, 'DU/' || o_orderkey AS identifier, o_orderkey::VARCHAR AS own_id FROM orders
UNION ALL SELECT 'draft:' || c_custkey, 'draft', c_name, NULL, c_mktsegment, c_name, c_custkey::VARCHAR FROM customer"""

def learned_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents in letters alone, stemmed by rules learned from the library's word list: number of words and digest for each document."""
    words = F.filter(F.split(F.lower(F.col("title")), r"[^\p{L}]+"), lambda w: w != "")
    rules = materialize(analysis.edit_commands(analysis.known_forms(spark)), "rules")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("title"))
    done = analysis.analysed(texts, rules, words)
    return done.select("id", F.size("stems").cast("long").alias("n"), F.sha2(F.array_join("stems", " "), 256).alias("stems_sha256"))


#: Learns from the list by itself: votes of suffixes, the most frequent command, the longest suffix.
LEARNED_STEMS = rf"""WITH pairs AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{m}')" for f, m in word_forms())}) t(form, lemma)),
c AS (SELECT form, lemma, (SELECT max(i) FROM range(0, least(length(form), length(lemma)) + 1) r(i) WHERE left(form, i) = left(lemma, i)) AS shared FROM pairs),
v AS (SELECT form, length(form) - shared AS cut, substr(lemma, shared + 1) AS put, unnest(generate_series(greatest(1, length(form) - shared), least(8, length(form)))) AS n FROM c),
g AS (SELECT right(form, n) AS suffix, cut, put, count(*) AS votes FROM v GROUP BY ALL), r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY votes DESC, cut, put) = 1),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}]+'), lambda w: w <> '' AND NOT list_contains([{", ".join(repr(w) for w in STOP_WORDS)}], w)) AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
u AS (SELECT DISTINCT w FROM t), e AS (SELECT w, unnest(generate_series(1, least(8, length(w)))) AS n FROM u),
b AS (SELECT w, arg_max(left(w, length(w) - cut) || put, n) AS stem FROM e JOIN r ON suffix = right(w, n) WHERE length(w) - cut >= 2 GROUP BY w),
s AS (SELECT doc_id, list(coalesce(stem, w) ORDER BY i) AS s FROM t LEFT JOIN b USING (w) GROUP BY doc_id)
SELECT doc_id::VARCHAR AS id, coalesce(len(s), 0)::BIGINT AS n, sha256(array_to_string(coalesce(s, []), ' ')) AS stems_sha256 FROM d LEFT JOIN s USING (doc_id)"""

QUERIES = {f.__name__: f for f in (bm25_scores, bm25_search, published_search, search_facets, search_total, facets, phrase_and, browse_filter, title_stems, title_highlight, stems_subset, learned_stems, index_entries)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
