"""Archive, writes, matching, search, audit, jobs, constraints, sinks."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from statutum.functions.text import normalise_title, stems
from statutum.operators import alerts, archive, audit, jobs, matching, paging, search, sinks, validation, writes
from statutum.schemas import RULES, SCHEMAS


def test_archive_dedup(spark):
    held = archive.with_hashes(spark.createDataFrame([("s", "a", b"1", 0)], "source string, external_id string, payload binary, arrival int"))
    rows = spark.createDataFrame([("s", "a", b"1", 1), ("s", "a", b"2", 2), ("s", "a", b"2", 3), ("t", "a", b"1", 4), ("s", "b", None, 5)], "source string, external_id string, payload binary, arrival int")
    assert sorted(r.arrival for r in archive.new_documents(held, rows).collect()) == [2, 4, 5]
    assert [r.outcome for r in archive.archive_outcomes(held, rows).orderBy("arrival").collect()] == ["already_known", "stored", "already_known", "stored", "stored"]


def test_versions_do_not_return(spark):
    rows = spark.createDataFrame([("d", "A", 1), ("d", "B", 2), ("d", "A", 3)], "document_id string, content_hash string, arrival int")
    assert [(r.version_no, r.content_hash, r.previous_hash) for r in writes.version_chain(rows).orderBy("version_no").collect()] == [(1, "A", None), (2, "B", "A")]


def test_document_titles_and_kinds(spark):
    rows = spark.createDataFrame([("s", "a", "old", "print", 1), ("s", "a", "new", "act", 2), ("s", "a", None, "club", 3)], "source string, external_id string, title string, kind string, arrival int")
    r = writes.documents_of(rows).first()
    assert (r.title, r.kind) == ("new", "print")


def test_merges(spark):
    old = spark.createDataFrame([("k", "id1", "x", 1), ("l", "id2", "y", 1)], "k string, id string, v string, at int")
    new = spark.createDataFrame([("k", "id3", None, 2), ("m", "id4", "z", 2), ("m", "id5", "w", 3)], "k string, id string, v string, at int")
    got = {r.k: (r.id, r.v) for r in writes.merge_latest(old, new, ["k"], "at", keep=("id",)).collect()}
    assert got == {"k": ("id1", None), "l": ("id2", "y"), "m": ("id5", "w")}
    assert {r.k: r.id for r in writes.insert_absent(old, new, ["k"], "at").collect()} == {"m": "id4"}


def test_edges_of_the_newest_version(spark):
    rows = [("A", 1, "A", "B", "amends"), ("A", 2, "A", "C", "amends"), ("A", 2, "D", "A", "amends"), ("A", 2, "A", "A", "amends"), ("E", 1, "E", "F", "amends"), ("E", 2, None, None, None)]
    got = writes.replace_edges(spark.createDataFrame(rows, "stated_by string, version_no int, from_eli string, to_eli string, relation string"))
    assert {(r.from_eli, r.to_eli) for r in got.collect()} == {("A", "C"), ("D", "A")}


def test_completeness(spark):
    schema = "source string, prefix string, declared long, archived long, authoritative boolean"
    rows = [("a", "x", 1000, 997, True), ("b", "x", 1000, 900, True), ("c", "x", 100, 120, True), ("d", "x", 40, 40, False), ("e", "x", 0, 0, True)]
    found = archive.completeness_findings(spark.createDataFrame(rows, schema))
    assert {r.source: (round(r.missing, 3), r.gap) for r in found.collect()} == {"a": (0.003, False), "b": (0.1, True), "c": (-0.2, False), "d": (0.0, False), "e": (0.0, False)}
    assert {r.source: r.complete for r in archive.completeness(found).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": True}


def test_direct_children_leave_deeper_ones(spark):
    rows = [("s", f"term10/proceeding/{n}", n) for n in range(40)] + [("s", f"term10/proceeding/{n}/voting/{v}", v) for n in range(40) for v in range(3)]
    docs = spark.createDataFrame(rows, "source string, external_id string, x int")
    assert archive.direct_children_count(docs, "s", "term10/proceeding/").first().archived == 40
    declared = spark.createDataFrame([("s", "term10/proceeding/", 40), ("s", "none/", 1)], "source string, prefix string, declared int")
    assert {r.prefix: r.archived for r in archive.archived_by_prefix(docs, declared).collect()} == {"term10/proceeding/": 40, "none/": 0}


TITLES = ["Ustawa o cenach energii elektrycznej", "Ustawa o zmianie ustawy o podatku od towarów", "Ustawa o ochronie zwierząt", "Ustawa o ochronie zwierzat i roślin", "Prawo budowlane", "Ustawa o cenach energii elektrycznej"]


def similar(a, b):
    grams = lambda x: {f"  {w} "[i : i + 3] for w in x.split() for i in range(len(w) + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_best_titles_match_brute_force(spark):
    acts = [(f"a{i}", t, date(2024, 1, 1 + i)) for i, t in enumerate(TITLES)] + [("a9", "Ustawa o ochronie zwierząt", None)]
    prints = [("p1", "Ustawa o cenach energii", date(2024, 1, 3)), ("p2", "Ustawa o ochronie zwierząt", None), ("p3", "Ustawa o ochronie zwierząt", date(2024, 1, 4)), ("p4", "zzz", None), ("p5", None, None), ("p6", "Prawo budowlane", date(2025, 1, 1)), ("p7", "", None), ("p8", "Ustawa o cenach energii", date(2024, 1, 1))]
    a = spark.createDataFrame(acts, "act_id string, title string, announced_on date").withColumn("title", normalise_title(F.col("title")))
    p = spark.createDataFrame(prints, "print_id string, title string, published_on date").withColumn("title", normalise_title(F.col("title")))
    norm = {t: spark.range(1).select(normalise_title(F.lit(t))).first()[0] for t in {x[1] for x in acts + prints if x[1] is not None}}
    want = {}
    for pid, title, day in prints:
        ok = [(-round(similar(norm[title], norm[t]), 9), aid) for aid, t, when in acts if title is not None and (day is None or (when is not None and when >= day))]
        ok = [x for x in ok if -x[0] >= 0.35]
        if ok:
            want[pid] = (min(ok)[1], -min(ok)[0])
    got = {r.print_id: (r.act_id, round(r.score, 9)) for r in matching.best_titles(p, a).collect()}
    assert got == want and "p2" in want and "p6" not in want


def test_decisions_on_scores(spark):
    assert [r.x for r in spark.createDataFrame([(0.6,), (0.59,), (0.35,), (0.34,)], "s double").select(matching.match_decision(F.col("s")).alias("x")).collect()] == ["fuzzy", "review", "review", "none"]


def entries(spark):
    rows = [("act:1", "act", "Ustawa o cenach energii", "DU/2024/1", None, None, ["DU/2024/1"]), ("draft:1", "draft", "Rządowy projekt ustawy o cenach energii", None, "rzadowy", "i_czytanie", ["UD1"]), ("act:2", "act", "Prawo budowlane", "DU/2024/1222", None, None, ["DU/2024/1222"]), ("draft:2", "draft", "Poselski projekt ustawy", None, "poselski", "ii_czytanie", ["UD2"])]
    frame = spark.createDataFrame(rows, "id string, kind string, title string, eli string, initiator string, stage string, identifiers array<string>")
    return frame.withColumn("act_type", F.lit(None).cast("string")).withColumn("stems", stems(F.col("title")))


def test_search(spark):
    e = entries(spark)
    found = search.search(e, "ustawy o cenach energii")
    ids = [r.id for r in found["hits"].collect()]
    assert ids[0] in ("act:1", "draft:1") and "act:2" not in ids and found["total"].first().total >= 2
    assert "<em>cenach</em>" in found["hits"].first().highlight
    facets = {(r.field, r.value): r.n for r in search.search(e, "projekt ustawy")["facets"].collect()}
    assert facets[("kind", "draft")] == 2 and facets[("kind", "act")] == 1 and {v for f, v in facets if f == "initiator"} == {"rzadowy", "poselski"}
    assert {v for f, v in facets if f == "stage"} == {"i_czytanie", "ii_czytanie"}
    assert [r.id for r in search.search(e, "UD2")["hits"].collect()] == ["draft:2"]
    assert [r.id for r in search.search(e, " ", offset=1, size=2)["hits"].collect()] == ["act:2", "draft:1"]
    assert search.search(e, "cen", kinds=("draft",))["total"].first().total == 1
    assert search.search(e.limit(0), "cen")["total"].first().total == 0


def test_titles_with_all_words(spark):
    words = spark.createDataFrame([("prawa budowlanego",), ("prawo lotnicze kosmiczne",), ("o na",)], "value string").withColumn("wanted", stems(F.col("value")))
    assert [(r.value, r.id) for r in search.titles_matching(entries(spark), words).collect()] == [("prawa budowlanego", "act:2")]


def test_profiles(spark):
    items = spark.createDataFrame([("i1", "act", "1", "DU/2024/1", ["ustawa", "cen"]), ("i2", "draft", "9", None, ["ustawa"]), ("i3", "act", "2", "DU/2024/2", None)], "item_id string, kind string, subject string, eli string, stems array<string>")
    rows = [("o", "p", "act", "DU/2024/1", False, None), ("o", "p", "keyword", "ustawy", False, ["ustawa"]), ("o", "p", "keyword", "nie", False, []), ("o", "q", "keyword", "u", False, ["ustawa"]), ("o", "q", "keyword", "c", True, ["cen"]), ("o", "r", "draft", "9", False, None), ("o", "r", "keyword", "n", False, None)]
    interests = spark.createDataFrame([(o, p, 1, k, v, e, s) for o, p, k, v, e, s in rows], "owner_id string, profile_id string, version int, kind string, value string, excluded boolean, stems array<string>")
    got = {(r.item_id, r.profile_id, r.kind) for r in matching.interested_profiles(items, interests).collect()}
    assert got == {("i1", "p", "act"), ("i1", "p", "keyword"), ("i2", "p", "keyword"), ("i2", "q", "keyword"), ("i2", "r", "draft")}


def test_covered_interests_go(spark):
    rows = [("p", "pkd", False, v) for v in ("62", "62.01", "62.0", "62.01.Z", "63.0")] + [("p", "region", False, v) for v in ("14", "1465", "02")] + [("p", "pkd", True, "62.01")]
    got = matching.uncovered_interests(spark.createDataFrame(rows, "profile_id string, kind string, excluded boolean, value string"))
    assert {(r.value, r.excluded) for r in got.collect()} == {("62", False), ("63.0", False), ("14", False), ("02", False), ("62.01", True)}


def log(spark, n=6):
    rows = [("a" if i < 4 else "b", i, i * 1000, None if i == 1 else "u", None, "GET", f"/x{i}", "succeeded", 200 if i else None, None) for i in range(n)]
    return spark.createDataFrame(rows, "log_id string, sequence long, at_ms long, actor string, actor_label string, action string, resource string, outcome string, status int, peer string")


def test_audit_chain(spark):
    chained = audit.chain(log(spark)).cache()
    report = lambda f: {r.log_id: (r.checked, r.intact, r.broken_at, r.why) for r in audit.verify(f).collect()}
    assert report(chained) == {"a": (4, True, None, None), "b": (2, True, None, None)}
    edited = chained.withColumn("resource", F.when(F.col("sequence") == 2, "/y").otherwise(F.col("resource")))
    assert report(edited)["a"] == (2, False, 2, "content")
    assert report(chained.where("sequence <> 1"))["a"] == (1, False, 2, "link")
    assert report(chained.where("sequence > 0"))["a"] == (3, True, None, None)  # a walk may start anywhere
    assert [r.sequence for r in audit.history(chained, "u", 2).collect()] == [5, 4]
    chained.unpersist()


def test_audit_csv(spark, tmp_path):
    rows = log(spark, 2).withColumn("resource", F.lit('a "b", c')).repartition(1)
    audit.history_csv(rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.splitlines()[0] == '"at","action","resource","outcome","status"' and '"a ""b"", c"' in text and text.rstrip().endswith(('"200"', '""'))


JOB = "job_id string, status string, priority int, run_after timestamp, attempts int, max_attempts int, dedup_key string, locked_at timestamp, requested_at timestamp"


def test_jobs(spark):
    t = datetime(2026, 1, 1)
    rows = [("1", "pending", 100, t, 0, 5, "k", None, t), ("2", "pending", 10, t, 0, 5, None, None, t), ("3", "running", 10, t, 4, 5, "m", t, t), ("4", "done", 10, t, 5, 5, "z", None, t), ("5", "pending", 10, datetime(2027, 1, 1), 0, 5, None, None, t)]
    j = spark.createDataFrame(rows, JOB)
    now = F.lit("2026-01-01 00:20:00").cast("timestamp")
    assert [(r.job_id, r.attempts) for r in jobs.claim(j, now).orderBy("priority").collect()] == [("2", 1), ("1", 1)]
    assert sorted(r.job_id for r in jobs.enqueue(j, spark.createDataFrame([("6", "k", t), ("7", "z", t), ("8", "z", t), ("9", None, t), ("10", None, t)], "job_id string, dedup_key string, requested_at timestamp")).collect()) == ["10", "7", "9"]
    assert {r.job_id: r.status for r in jobs.reclaim(j, now).collect()}["3"] == "pending"
    failed = {r.job_id: (r.status, r.delay_to) for r in jobs.after_failure(j).collect()}
    assert failed["4"] == ("dead", None) and failed["3"] == ("pending", 80.0)


def test_tokens(spark):
    t = lambda s: datetime(2026, 1, 1, 0, 0, s)
    tokens = spark.createDataFrame([("a", "f", t(59), None, None), ("b", "f", t(59), None, None), ("c", "g", t(1), None, None), ("d", "h", t(59), None, t(0))], "token_id string, family_id string, expires_at timestamp, used_at timestamp, revoked_at timestamp")
    shown = spark.createDataFrame([("a", t(0)), ("a", t(10)), ("a", t(30)), ("b", t(20)), ("b", t(40)), ("c", t(5)), ("d", t(5)), ("x", t(1))], "token_id string, at timestamp")
    got = {(r.token_id, r["at"].second): r.outcome for r in jobs.present_tokens(shown, tokens).collect()}
    assert got == {("a", 0): "rotated", ("a", 10): "rotated", ("a", 30): "reuse", ("b", 20): "rotated", ("b", 40): "reuse", ("c", 5): "expired", ("d", 5): "reuse", ("x", 1): "unknown"}


def test_constraints(spark):
    rows = spark.createDataFrame([("1", True, None), ("2", False, None), ("3", True, "law"), ("4", None, None)], "k string, enabled boolean, legal_basis string")
    assert [tuple(r) for r in validation.violations(rows, "source", "k").collect()] == [("source", "enabled_needs_legal_basis", "1")]
    for table, rules in RULES.items():  # every rule is sound SQL over its table
        frame = spark.createDataFrame([], SCHEMAS[table])
        assert validation.violations(frame, table, frame.columns[0]).count() == 0, rules


def test_pages(spark):
    rows = spark.range(10).withColumn("owner_id", F.lit("a"))
    assert [r.id for r in paging.after(rows, "id", 3, 2).collect()] == [4, 5]
    assert paging.page(rows, [F.col("id")], -5, 500).count() == 10 and paging.newest(rows, "id", "id", 0).count() == 1
    assert paging.where_given(rows, id=[1, 2], owner_id=None).count() == 2 and paging.owned_by(rows, "b").count() == 0


def test_blobs_are_added_once(spark, tmp_path):
    rows = archive.with_hashes(spark.createDataFrame([(b"1",), (b"2",), (b"1",)], "payload binary")).select("content_hash", "payload")
    for _ in range(2):
        sinks.write_blobs(rows, str(tmp_path))
    assert sinks.read_blobs(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError, match="no bucket"):
        sinks.write_blobs(rows, str(tmp_path), "other")


def test_index_is_switched(spark, tmp_path):
    sinks.publish_index(entries(spark), str(tmp_path), "ix")
    assert spark.table("ix").count() == 4
    by_index, by_title = (search.search(spark.table("ix"), "ceny energii", index=i)["hits"].select("id", "score").collect() for i in (spark.table("ix_postings"), None))
    assert by_index == by_title != []
    sinks.publish_index(entries(spark).where("kind = 'act'"), str(tmp_path), "ix")
    assert spark.table("ix").count() == 2 and spark.table("ix_postings").where("stem = 'cen'").count() == 1


def test_published_indexes_switch_and_go(spark, tmp_path):
    """The alias names the newest complete index; searches of it equal those of the entries; indexes before the last are removed."""
    root, e = str(tmp_path), entries(spark)
    with pytest.raises(FileNotFoundError):
        sinks.live_index(spark, root)
    first = sinks.publish_index(e.where("kind = 'act'"), root)
    held = sinks.live_index(spark, root)
    second = sinks.publish_index(e, root)
    live = sinks.live_index(spark, root)
    for text in ("ustawy o cenach energii", "projekt ustawy", "zzz"):
        got, want = (search.search(x, text, index=i) for x, i in ((live.entries, live), (e, None)))
        assert [(r.id, round(r.score, 9)) for r in got["hits"].collect()] == [(r.id, round(r.score, 9)) for r in want["hits"].collect()]
        assert got["total"].first() == want["total"].first()
    assert held.entries.count() == e.where("kind = 'act'").count()  # what a running search holds stays
    third = sinks.publish_index(e, root)
    assert [os.path.isdir(p) for p in (first, second, third)] == [False, True, True]


def test_a_run_has_passes(spark):
    rows = spark.range(30).select(F.lit("act").alias("kind"), F.col("id").alias("subject"), F.timestamp_seconds(F.lit(100) - F.col("id")).alias("arrived_at"), F.when(F.col("id") < 3, F.lit(0).cast("timestamp")).alias("processed_at"))
    got = {r.subject: r.pass_no for r in alerts.run_passes(rows, 5, 3).collect()}
    assert got == {29 - k: k // 5 + 1 for k in range(15)}


def test_repeated_interests_count_once(spark):
    items = spark.createDataFrame([("i1", "act", "1", "DU/2024/1", ["urgent", "c1"])], "item_id string, kind string, subject string, eli string, stems array<string>")
    rows = [("o", "p", 1, "keyword", "urgent", False, ["urgent"])] * 3 + [("o", "p", 1, "act", "DU/2024/1", False, None)] * 2
    interests = spark.createDataFrame(rows, "owner_id string, profile_id string, version int, kind string, value string, excluded boolean, stems array<string>")
    assert sorted((r.kind, r.value) for r in matching.interested_profiles(items, interests).collect()) == [("act", "DU/2024/1"), ("keyword", "urgent")]
