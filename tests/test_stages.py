"""Timelines, medians, statuses: golden values and edge cases."""

from datetime import date, datetime

from pyspark.sql import functions as F

from statutum.operators import legislative as op
from statutum.operators.writes import append_facts

STAGES = "draft_id string, ordinal int, day date, stage string"
FACTS = "draft_id string, stage string, ordinal int, valid_from timestamp, valid_to timestamp, known_at timestamp"


def d(text):
    return date.fromisoformat(text)


def t(text):
    return datetime.fromisoformat(text)


def timeline(spark, *rows):
    frame = spark.createDataFrame([("x", o, day and d(day), s) for o, day, s in rows], STAGES)
    return op.stage_timeline(frame)


def days(frame):
    return [(r.ordinal, str(r.valid_from.date()), r.valid_to and str(r.valid_to.date())) for r in frame.orderBy("valid_from", "ordinal").collect()]


def test_a_stage_lasts_until_the_next(spark):
    assert days(timeline(spark, (0, "2023-11-20", "a"), (1, "2023-11-28", "b"))) == [(0, "2023-11-20", "2023-11-28"), (1, "2023-11-28", None)]


def test_stages_of_one_day_last_a_day(spark):
    got = days(timeline(spark, (2, "2023-11-29", "c"), (0, "2023-11-29", "a"), (1, "2023-11-29", "b"), (3, "2023-12-08", "d")))
    assert got == [(0, "2023-11-29", "2023-11-30"), (1, "2023-11-29", "2023-11-30"), (2, "2023-11-29", "2023-12-08"), (3, "2023-12-08", None)]


def test_undated_rows_go_and_dates_order(spark):
    assert days(timeline(spark, (0, None, "a"), (1, "2023-12-08", "b"), (2, "2023-11-28", "c"))) == [(2, "2023-11-28", "2023-12-08"), (1, "2023-12-08", None)]


def exceptions(spark, *stages):
    rows = timeline(spark, *[(i, f"2024-01-{i + 1:02d}", s) for i, s in enumerate(stages)])
    return [(r.stage, r.exception) for r in op.with_exceptions(rows).orderBy("ordinal").collect()]


def test_moves(spark):
    assert [e for _, e in exceptions(spark, "ii_czytanie", "praca_w_komisjach", "iii_czytanie")] == [False] * 3
    assert [e for _, e in exceptions(spark, "wplynal_do_sejmu", "podpisany_przez_prezydenta")] == [False, True]
    assert exceptions(spark, "wplynal_do_sejmu", None) == [("wplynal_do_sejmu", False), ("nieznany", False)]
    assert [e for _, e in exceptions(spark, "stanowisko_senatu", "stanowisko_senatu", "rozpatrzenie_stanowiska_senatu")] == [False] * 3


def stays(spark, rows):
    return spark.createDataFrame([(i, s, n * 86400) for i, s, n in rows], "initiator string, stage string, seconds long")


def test_median_of_enough_stays(spark):
    paces = op.stage_paces(stays(spark, [("rzadowy", "k", n) for n in (2, 4, 6, 8, 10)]))
    assert {(r.overall, r.median_seconds) for r in paces.collect()} == {(False, 6 * 86400), (True, 6 * 86400)}


def test_fallback_to_all_initiators(spark):
    rows = [("rzadowy", "k", 30)] * 5 + [("obywatelski", "k", 2)]
    asked = spark.createDataFrame([("obywatelski", "k"), ("obywatelski", "m"), ("rzadowy", "k")], "initiator string, stage string")
    got = {(r.initiator, r.stage): r.pace for r in op.pace_or_fallback(asked, op.stage_paces(stays(spark, rows))).collect()}
    assert got == {("obywatelski", "k"): 30 * 86400, ("obywatelski", "m"): None, ("rzadowy", "k"): 30 * 86400}


def test_even_medians_lie_between(spark):
    paces = op.stage_paces(stays(spark, [("a", "k", 1), ("a", "k", 2)])).where("overall").first()
    assert paces.median_seconds == 86400 * 3 // 2


def status(spark, pace_days, stage="ii_czytanie", closed=None, n=5, since="2024-02-01"):
    history = spark.createDataFrame([("x", stage, 4, t(since), None, t(since))], FACTS)
    drafts = spark.createDataFrame([("x", "rzadowy", "a", closed), ("empty", "rzadowy", None, None)], "draft_id string, initiator string, act_id string, closed_at timestamp")
    acts = spark.createDataFrame([("a", d("2024-06-01"))], "act_id string, in_force_from date")
    paces = op.stage_paces(stays(spark, [("rzadowy", stage, pace_days)] * n))
    rows = op.draft_status(drafts, history, paces, acts, F.lit("2024-03-10").cast("timestamp")).collect()
    assert [r.draft_id for r in rows] == ["x"]  # a draft without history has no row
    return rows[0]


def test_status(spark):
    r = status(spark, 14)
    assert (r.next_stage, r.expected_at, r.deadline, r.deadline_kind) == ("iii_czytanie", t("2024-02-15"), t("2024-06-01"), "wejscie_w_zycie")
    assert status(spark, 7).stalled_since == t("2024-02-15")
    assert status(spark, 60).stalled_since is None
    assert status(spark, 14, n=2).expected_at is None
    closed = status(spark, 7, closed=t("2024-03-01"))
    assert (closed.next_stage, closed.expected_at, closed.stalled_since) == (None, None, None)


def test_current_stage_takes_ordinal_then_the_earliest_statement(spark):
    rows = [("x", s, o, t("2024-01-05"), None, t(k)) for s, o, k in (("a", 4, "2024-01-06"), ("b", 5, "2024-01-06"), ("c", 6, "2024-01-08"), ("d", 6, "2024-01-07"))]
    assert op.current_stage(spark.createDataFrame(rows, FACTS)).first().stage == "d"


def test_as_of_takes_both_times(spark):
    rows = [("x", "a", 0, t("2023-12-01"), t("2023-12-20"), t("2023-12-01")), ("x", "b", 1, t("2023-12-20"), None, t("2024-02-01"))]
    facts = spark.createDataFrame(rows, FACTS)
    at = lambda day, known: [r.stage for r in op.as_of(facts, F.lit(day).cast("timestamp"), F.lit(known).cast("timestamp")).collect()]
    assert at("2023-12-10", "2024-03-01") == ["a"] and at("2024-01-10", "2024-01-15") == [] and at("2024-01-10", "2024-03-01") == ["b"]
    assert at("2023-12-20", "2024-03-01") == ["b"]


def test_facts_are_added_once(spark):
    rows = spark.createDataFrame([("x", "a", 0, t("2024-01-01"), None, t("2024-01-02"), False), ("x", "a", 0, t("2024-01-01"), t("2024-01-05"), t("2024-01-06"), False)], FACTS + ", exception boolean")
    assert append_facts(rows, rows).count() == 0
    assert append_facts(rows.limit(0), rows.unionByName(rows)).count() == 2
    empty = spark.createDataFrame([("x", "a", 0, t("2024-01-01"), t("2024-01-01"), t("2024-01-02"), False)], FACTS + ", exception boolean")
    assert append_facts(rows, empty).count() == 0


def test_empty_tables(spark):
    assert timeline(spark).count() == 0
    assert op.stage_paces(stays(spark, [])).count() == 0


def test_citations_and_cards(spark):
    acts = spark.createDataFrame([("1", "DU/2024/1", "One", d("2024-01-01"), d("2024-01-01")), ("2", "DU/2024/2", "Two", d("2024-02-01"), None)], "act_id string, eli string, title string, announced_on date, in_force_from date")
    edges = spark.createDataFrame([("DU/2024/1", "DU/2024/2", "amends"), ("DU/2024/1", "DU/1999/9", "repeals")], "from_eli string, to_eli string, relation string")
    names = spark.createDataFrame([("1", "eli", "DU/2024/1")], "act_id string, scheme string, value string")
    drafts = spark.createDataFrame([("d2", "1", t("2024-01-02")), ("d1", "1", t("2024-01-01"))], "draft_id string, act_id string, created_at timestamp")
    cards = {r.eli: r for r in op.act_cards(acts, names, edges, drafts).collect()}
    assert [c.other_eli for c in cards["DU/2024/1"].cites] == ["DU/2024/2", "DU/1999/9"]  # unresolved, undated last
    assert cards["DU/2024/1"].vacatio_days == 0 and cards["DU/2024/2"].vacatio_days is None
    assert cards["DU/2024/1"].source_draft == "d1" and len(cards["DU/2024/2"].cited_by) == 1


def test_edges_are_oriented(spark):
    rows = [("DU/2024/1", "Akty zmienione", "DU/2020/1"), ("DU/2024/1", "Akty zmieniające", "DU/2025/1"), ("DU/2024/1", "Akty zmienione", "DU/2024/1"), ("DU/2024/1", "Coś", "DU/2020/2"), ("DU/2024/1", "Akty zmienione", "DU/2020/1")]
    refs = spark.createDataFrame(rows, "eli string, label string, target string")
    assert {tuple(r) for r in op.orient_edges(refs).collect()} == {("DU/2024/1", "DU/2020/1", "amends"), ("DU/2025/1", "DU/2024/1", "amends")}
    assert [tuple(r) for r in op.unmapped_labels(refs).collect()] == [("Coś", 1)]
