"""The registered queries of the training-data operators, over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, embedding_dedup, licenses, mixing, near_dedup, quality, resampling, secrets, substring_dedup, token_tables, toxicity, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return out.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, hundreds of the id, id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.floor(F.col("doc_id") / 100), "doc_id")
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "line", "last_line", "inherited_from")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op8_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.branched_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_embedding_dedup, op4_decontamination, op5_toxicity, op6_license_scan, op7_secret_scan, op8_token_tables, op9_near_dedup, op10_mixing, op11_importance_resampling, op12_quality_rules, op13_conversation_trie)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS k FROM s),
r AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN r USING (k), generate_series(0, 34) AS t(j)),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
q AS (SELECT p.doc_id, list(word ORDER BY p.p) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p WHERE c.p IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(array_to_string(coalesce(kept, []), ' ')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
o AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, x, max(page_id) OVER (PARTITION BY x) AS owner FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(x, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM o
"""

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS k FROM v),
n AS (SELECT DISTINCT n FROM k),
s AS (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, n WHERE len(w) >= n),
h AS (SELECT s.doc_id, s.i, s.n, k.item_id FROM s JOIN k ON k.n = s.n AND k.k = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, generate_series(0, 12) AS t(j) WHERE j < n GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""

#: Exact similarities: an inverted index of shingles counts what documents share; a recursive closure names components.
OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, d.doc_id = coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id AND x.n > 0 AND y.n > 0 AND list_dot_product(x.v, y.v) / x.n / y.n >= 0.95),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a, count(*) AS c FROM e GROUP BY a),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM u LEFT JOIN c ON c.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

#: The table of crc32 and the unsigned crc32 of every distinct string w of ``words``, byte by byte.
CRC_SQL = """
crc_table AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM words)), crc_table)"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b), words AS (SELECT w FROM dw UNION ALL SELECT w FROM bw), {CRC_SQL},
s AS (SELECT crc % 10000 AS k, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY 1), t AS (SELECT crc % 10000 AS k, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY 1),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
g AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k), n),
m AS (SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN g ON g.k = crc % 10000 GROUP BY doc_id),
h AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM h WHERE n_features >= 20)
SELECT h.doc_id, n_features, weight, (weight + noise)::BIGINT AS score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM h LEFT JOIN r USING (doc_id)
"""

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d), words AS (SELECT w FROM p), {CRC_SQL},
c AS (SELECT doc_id, i, crc FROM p JOIN crc USING (w)),
f AS (SELECT doc_id, (65599 + crc) % 10007 AS k FROM c
  UNION ALL SELECT a.doc_id, ((131198 + a.crc) % 10007 * 65599 + z.crc) % 10007 FROM c a JOIN c z ON z.doc_id = a.doc_id AND z.i = a.i + 1),
o AS (SELECT doc_id, k, count(*) AS n FROM f GROUP BY ALL), m AS (SELECT doc_id, sum(n)::BIGINT AS m FROM o GROUP BY doc_id),
s AS (SELECT k, sum(n) AS s FROM o GROUP BY k), t AS (SELECT k, sum(n) AS t FROM o SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) GROUP BY k),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
g AS (SELECT doc_id, sum(n * floor(1000 * ln((coalesce(t, 0)::DOUBLE * ((s_all - m + 10007) / (s - n + 1)::DOUBLE) + 10007) / (t_all + 10007))))::BIGINT AS ratio FROM o JOIN m USING (doc_id) JOIN s USING (k) LEFT JOIN t USING (k), n GROUP BY doc_id),
w3 AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM d WHERE len(ws) > 2), k3 AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM w3),
r3 AS (SELECT doc_id, k FROM k3 GROUP BY ALL HAVING count(*) > 1), c3 AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k3 JOIN r3 USING (doc_id, k), generate_series(0, 2) AS j(j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), l2 AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
q AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l2.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(m, 0)::BIGINT AS n_features, coalesce(ratio, 0)::BIGINT AS ratio_sum
  FROM d LEFT JOIN l2 USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT *, NOT base_failed AND ratio_sum >= -75 * n_features AS kept FROM v
"""

OP13_SQL = f"""
WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
words AS (SELECT conv_id::VARCHAR AS w FROM o), {CRC_SQL},
h AS (SELECT conv_id, o.w, crc % 6 AS h FROM o JOIN crc ON crc.w = conv_id::VARCHAR),
r AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 100),
e AS (SELECT conv_id, w, unnest(generate_series(0, len(w))) AS d FROM r),
p AS (SELECT conv_id, d, w[1:d] AS k, d = len(w) AS ends, CASE WHEN d = 0 THEN 0 ELSE length(w[d].t) END AS tokens FROM e),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(tokens) AS tokens, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT n.d AS at, n.k, (n_convs - 1) * tokens AS saved, n_children IS NULL AS leaf, unnest(generate_series(0, n.d)) AS d FROM n LEFT JOIN c ON c.d = n.d AND c.k = n.k),
s AS (SELECT d, k[1:d] AS k, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM v GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.k = n.k LEFT JOIN c ON c.d = n.d AND c.k = n.k LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]
"""

SQL = {"op1_substring_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op9_near_dedup": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_conversation_trie": OP13_SQL}
