"""What grows with the input, and what must not, of the queries that were found to grow too fast."""

import itertools
import random

from pyspark.sql import functions as F

from statutum.llm import common, secrets
from statutum.operators import analysis, matching
from statutum.plans import streams
from statutum.sources import government
from statutum.streaming import alerts as live
from statutum.streaming import digests


def finished(query):
    query.awaitTermination(120)
    return query


def state_rows(query):
    return max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)


def test_owners_of_digests_share_a_bounded_number_of_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "BUCKETS", 2)
    live.use_rocksdb(spark)
    rows = spark.range(60).select(F.col("id").cast("string").alias("notification_id"), (F.col("id") % 30).cast("string").alias("owner_id"), F.lit("normal").alias("urgency"), F.timestamp_seconds(86400 + F.col("id") * 60).alias("created_at"), F.lit("hourly").alias("mode"), F.lit("UTC").alias("zone"), *(F.lit(None).cast("int").alias(c) for c in ("at_hour", "on_weekday", "quiet_from", "quiet_to")))
    late = rows.limit(1).withColumns({"notification_id": F.lit("z"), "owner_id": F.lit("z"), "created_at": F.timestamp_seconds(F.lit(2 * 86400))})
    rows.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = digests.digest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = finished(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")))
    got = spark.read.parquet(str(tmp_path / "o")).where("owner_id <> 'z'").select(F.unix_seconds("closed_at").alias("s")).collect()
    assert len(got) == 60 and {r.s for r in got} == {86400 + 3600}
    assert state_rows(query) < 30


def test_matters_of_cooldown_share_a_bounded_number_of_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 2)
    live.use_rocksdb(spark)
    big = 1 << 60  # ids that a double can't hold, beside an owner without one
    rows = spark.range(40).select(F.when(F.col("id") % 20 > 0, big + F.col("id") % 20).alias("owner_id"), F.lit("c").alias("case_key"), F.col("id").alias("at"), F.col("id").alias("event_id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.cooldown_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = finished(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")))
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert {(r.owner_id, r.event_id) for r in got if r.raised} == {(big + i if i else None, i) for i in range(20)} and len(got) == 40
    assert state_rows(query) <= 2


def test_candidates_of_titles_are_judged_where_they_meet(spark):
    """Titles of few words are nearly all candidates: only similar pairs leave the join, each once."""
    words = ["ustawa", "projekt", "zmiana", "rynek", "energia", "\U0001f600kod", "za"]
    titles = [" ".join(x) for k in (1, 2, 3) for x in itertools.permutations(words, k)][::3]
    grams = {t: {p[i : i + 3] for w in t.replace("\U0001f600", " ").split() for p in [f"  {w} "] for i in range(len(p) - 2)} for t in titles}
    similarity = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b) for a in titles[::2] for b in titles[1::2] if similarity(grams[a], grams[b]) >= 0.35}
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "title string")
    found = matching.similar_titles(frame(titles[::2]), frame(titles[1::2]))
    above = found._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    got = [(r.title, r.other, r.score) for r in found.collect()]
    assert len(got) == len(want) and {g[:2] for g in got} == want
    assert all(abs(s - similarity(grams[a], grams[b])) < 1e-12 for a, b, s in got)


def test_titles_meet_in_blocks_and_are_told_apart_by_sketches(spark, monkeypatch):
    """No candidate makes an array in the join, and no trigram that all titles have is met in one block."""
    monkeypatch.setattr(matching, "SKETCH", 1)
    monkeypatch.setattr(matching, "BLOCKS", {"left": 7, "right": 3})
    draw = random.Random(5)
    pieces = ["ust", "awa", "o", "zmi", "anie", "en", "er", "gii", "\U0001f600k", "ż", "1", "xyz"]
    titles = ["", " ", "o", *(" ".join("".join(draw.choices(pieces, k=draw.randrange(1, 4))) for _ in range(draw.choice((1, 2, 4, 30)))) for _ in range(150))]
    grams = {t: {p[i : i + 3] for w in t.replace("\U0001f600", " ").split() for p in [f"  {w} "] for i in range(len(p) - 2)} for t in titles}
    similarity = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b]) if grams[a] and grams[b] else 0
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "title string")
    for floor in (0.35, 0.6):
        want = {(a, b) for a in titles[:90] for b in titles[60:] if similarity(a, b) >= floor}
        found = matching.similar_titles(frame(titles[:90] * 2), frame(titles[60:] * 2), floor)
        joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "SortMergeJoin" in line and "bit_count" in line]
        assert len(joins) == 1 and "array_intersect" not in joins[0]
        got = [(r.title, r.other, r.score) for r in found.collect()]
        assert len(got) == len(want) > 30 and {g[:2] for g in got} == want
        assert all(abs(s - similarity(a, b)) < 1e-12 for a, b, s in got)


def test_payloads_land_in_more_files_and_not_in_larger_ones(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(streams, "ARCHIVE_BYTES", 1 << 15)
    seen, land = [], streams._stream
    monkeypatch.setattr(streams, "_stream", lambda rows, name, files=None: seen.append((rows.rdd.getNumPartitions(), files)) or land(rows.limit(20).repartition(2), name, files))
    streams.stream_archive(spark, sf_dir)
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null").agg(F.sum(F.octet_length("text"))).first()[0]
    assert size > 4 << 15 and all(files == -(-size // (1 << 15)) and parts == 2 * files for parts, files in seen)


def test_every_ordinary_name_of_a_large_corpus_counts(spark):
    rows = spark.range(6000).select(F.concat(*(F.concat(F.translate(F.conv(F.xxhash64("id", F.lit(k)).cast("string"), 10, 16), "0123456789", "ghijklmnop"), F.lit(" ")) for k in range(16))).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("doc_id"), F.regexp_replace("text", "([A-Za-z]{8})", "$1 ").alias("text"))
    ordinary, shares = secrets.calibration(rows, {(62, 1), (36, 4)})
    assert set(shares.values()) == {1} and sum(sum(v.values()) for v in ordinary.values()) == secrets.ordinary_names(rows).count() > 20_000


def test_covered_interests_are_found_in_one_shuffle(spark):
    values = ["62", "62.0", "62.01", "62.0.1", "620", "62-1", "62.", "6", "ż", "żó", "", ".1", None]
    rows = [(p, k, e, v) for p in ("a", None) for k in ("pkd", "region", "act", None) for e in (True, None) for v in [*values, *values[::2]]]

    def covered(p, k, e, v):
        ends = {"pkd": lambda w: v.startswith(w + "."), "region": lambda w: w != "" and v.startswith(w)}.get(k)
        return None not in (p, e, v) and ends is not None and any(w is not None and w != v and ends(w) for w in values)

    found = matching.uncovered_interests(spark.createDataFrame(rows, "profile_id string, kind string, excluded boolean, value string").repartition(3))
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {r for r in rows if not covered(*r)}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("hashpartitioning") == 1


def test_plain_pages_have_the_tree_of_the_parser_without_it(monkeypatch):
    def parsed(page):
        parser = government._Tree()
        parser.feed(page)
        parser.close()
        return parser.root

    shape = lambda n: n if isinstance(n, str) else (n.tag, n.attrs, [shape(c) for c in n.children])
    pieces = ["<div>", "<DIV Class='a'>", '<Div Class="a  b" id="">', '<a href="/x/1"\n>', '<a href="?a=1&amp;b">', '<a href="x"/>', "<br/>", "<br>", "<br />", "</div>", "</DIV >", "</a>", "</p>", "<p>", "a &amp; ż", "&lt", "&#380;", " \n", "<", ">", "</", "<!-- x -->", "<!DOCTYPE html>", "<script>a<b</script>", "<sc\u0131pt>", "<b\u212a>", "<title>", "<x-y>", '<p id="1" id="2">', '<p id="a>b">', "<p id=1>", "<p id>", "&am"]
    draw = random.Random(7)
    pages = ["", *("".join(draw.choices(pieces[: draw.choice((10, 18, 99))], k=draw.randrange(12))) for _ in range(4000))]
    plain = [(p, government._plain_tree(p)) for p in pages]
    assert 500 < sum(t is not None for _, t in plain) < 4000
    assert all(shape(t) == shape(parsed(p)) for p, t in plain if t is not None)
    page = '<ul class="cbp_tmtimeline"><li id="5"><div class="cbp_tmlabel"><a href="/projekt/7/katalog/5">1. A &amp; b</a></div></li></ul>'
    monkeypatch.setattr(government._Tree, "feed", None)
    assert government.card_of(page)["stages"] == [{"catalog_id": "5", "heading": "1. A & b", "state": "done", "modified": None, "visitable": True}]


def test_texts_are_stemmed_where_they_are_read(spark, monkeypatch):
    rules = analysis.edit_commands(analysis.known_forms(spark)).localCheckpoint()
    texts = spark.createDataFrame([(1, "Ustawami o przepisach, ustawami i ę x xy"), (2, None), (3, ""), (4, "z do"), (5, "\U00010400\U00010401ami rządowego 12 odpowiedzialnościach")], "id long, title string").repartition(2)
    done = analysis.analysed(texts, rules)
    assert "Exchange hash" not in done._jdf.queryExecution().executedPlan().toString() and "Join" not in done._jdf.queryExecution().sparkPlan().toString()
    got = {r.id: r.stems for r in done.collect()}
    monkeypatch.setattr(analysis, "HELD", 3)  # more rules than a task may hold are joined
    assert {r.id: r.stems for r in analysis.analysed(texts, rules).collect()} == got
    assert len(got) == 5 and got[2] == got[3] == got[4] == [] and got[1][0] == got[1][2] == "ustawa"


def test_words_of_common_keywords_are_not_shuffled_with_profiles(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK_BITS", 1)
    monkeypatch.setattr(matching, "FEW", 1)
    items = [(i, "act", str(i), f"DU/2024/{i % 290}", [w for w, k in (("a", 1), ("b", 3), ("c", 100)) if i % k == 0]) for i in range(300)]
    asked = [(p, p, 1, "keyword", w, p == 2 and w == "b", [w]) for p in (1, 2, 3, None) for w in ("a", "b", "c")]
    asked += [(p, p, 1, "act", f"DU/2024/{n}", x, None) for p in (1, 3, None) for n, x in ((5, True), (6, False), (170, True))]
    made = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    found = matching.interested_profiles(made(items, "item_id long, kind string, subject string, eli string, stems array<string>"), made(asked, "owner_id int, profile_id int, version int, kind string, value string, excluded boolean, stems array<string>"))
    hits = {(i, p, k, v, x) for i, _, _, eli, stems in items for _, p, _, k, v, x, w in asked if (v == eli if k == "act" else w[0] in stems)}
    gone = {(i, p) for i, p, _, _, x in hits if x and p is not None}
    got = [(r.item_id, r.profile_id, r.kind, r.value) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {h[:4] for h in hits if not h[4] and h[:2] not in gone}
    shuffled = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in line]
    assert len(shuffled) == 1 and "profile_id" in shuffled[0] and "chunk" in shuffled[0]


def test_components_of_whole_numbers_are_found_without_sorts(spark, monkeypatch):
    draw = random.Random(3)
    edges = [(draw.randrange(-400, 400), draw.randrange(-400, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 6000 + i) for i in range(50)]
    plans, keep = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(plans) > 5 and not any("SortAggregate" in p for p in plans)
    text = {int(r.node): int(r.component) for r in common.components(spark.createDataFrame([(f"{a + 9000:05}", f"{b + 9000:05}") for a, b in edges], "a string, b string")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        before = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert got == root and text == {k + 9000: v + 9000 for k, v in root.items()}
