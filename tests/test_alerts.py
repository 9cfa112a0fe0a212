"""Alerts, digests, mails and deliveries."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from statutum.operators import alerts as op

CANDIDATE = "item_id string, owner_id string, profile_id string, version int, kind string, value string, subject_kind string, subject string, stage string, title string, at long"
H = 3600


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "rule_id string, profile_id string, enabled boolean, urgency string, stages array<string>")


def candidates(spark, *rows):
    return spark.createDataFrame([(i, o, p, 1, "keyword", "x", k, s, st, "T", at) for i, o, p, k, s, st, at in rows], CANDIDATE)


def told(spark, *rows):
    return spark.createDataFrame(list(rows), "owner_id string, case_key string, event_key string, at long")


def reasons(frame):
    return {r.item_id + r.profile_id: r.reason for r in frame.collect()}


def test_cascade(spark):
    r = rules(spark, ("1", "p1", True, "normal", None), ("2", "p2", False, "normal", None), ("3", "p3", True, "normal", ["i_czytanie"]))
    c = candidates(
        spark, ("a", "o", "p0", "draft", "d", "x", 0), ("a", "o", "p2", "draft", "d", "x", 0), ("a", "o", "p3", "draft", "d", "ii_czytanie", 0), ("b", "o", "p1", "draft", "d", "s1", 0), ("c", "o", "p1", "draft", "d", "s2", 24 * H), ("d", "o", "p1", "draft", "d", "s2", 24 * H + 1),
        ("e", "o", "p1", "draft", "d", "s1", 60 * H), ("f", "o", "p3", "act", "q", None, 5), ("g", "o2", "p1", "draft", "d", "s1", 1), ("h", "o", "p1", "draft", "z", "s", 90 * H),
    )
    past = told(spark, ("o", "draft:z", "draft:z@other", 89 * H))
    out = op.decide(c, r, past)
    assert reasons(out) == {
        "ap0": "no_rule", "ap2": "rule_disabled", "ap3": "stage_not_watched", "bp1": "matched", "cp1": "case_recently_raised", "dp1": "matched", "ep1": "already_told", "fp3": "matched", "gp1": "matched", "hp1": "case_recently_raised",
    }
    raised = op.new_notifications(out).collect()
    assert len(raised) == len({x.notification_id for x in raised}) == 4
    assert {x.decision for x in out.where("reason <> 'matched'").collect()} == {"withheld"}


def test_cooldown_counts_from_the_last_raised(spark):
    rows = [("o", "c", h * H, i) for i, h in enumerate((0, 20, 24, 25, 48, 50))]
    e = spark.createDataFrame([*rows, ("o", "c", 0, 9), ("p", "c", 1, 10)], "owner_id string, case_key string, at long, event_id int")
    got = {r.event_id: r.raised for r in op.cooldown(e).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True, 9: False, 10: True}
    assert op.cooldown(e.limit(0)).count() == 0


def test_volume_stays_low(spark):
    """60 acts and 10 drafts seen four times a day for a week; 15 acts and 4 drafts match; drafts move on days 1 and 4."""
    rows = []
    for day in range(7):
        for cycle in range(4):
            at = (day * 24 + cycle * 6) * H
            rows += [(f"{day}-{cycle}-a{n}", "o", "p", "act", f"a{n}", None, at) for n in range(15)]
            rows += [(f"{day}-{cycle}-d{n}", "o", "p", "draft", f"d{n}", "s0" if day < 1 else "s1" if day < 4 else "s2", at) for n in range(4)]
    out = op.decide(candidates(spark, *rows), rules(spark, ("1", "p", True, "normal", None)), told(spark))
    assert out.count() == 532
    raised = out.where("decision = 'raised'")
    assert 19 <= raised.count() < 70 and raised.where("subject_kind = 'act'").count() == 15


def test_best_reason(spark):
    rows = [("i", "p", "keyword", "a"), ("i", "p", "act", "z"), ("i", "p", "act", "b"), ("j", "p", "region", "x")]
    got = op.best_reason(spark.createDataFrame(rows, "item_id string, profile_id string, kind string, value string")).collect()
    assert {(r.item_id, r.kind, r.value) for r in got} == {("i", "act", "b"), ("j", "region", "x")}


def test_pending(spark):
    now = datetime(2026, 1, 1)
    held = spark.createDataFrame([("act", "1", now, None), ("act", "2", now, now)], "kind string, subject string, arrived_at timestamp, processed_at timestamp")
    new = spark.createDataFrame([("act", "1", now), ("act", "2", now), ("act", "2", now + timedelta(1)), ("act", "3", now)], "kind string, subject string, arrived_at timestamp")
    assert {r.subject for r in op.add_pending(held, new).collect()} == {"2", "3"} and op.add_pending(held, new).count() == 2
    items = op.resolve_items(held, spark.createDataFrame([("1", "T", "DU/2024/1")], "act_id string, title string, eli string"), spark.createDataFrame([], "draft_id string, title string, stage string"))
    assert {r.subject: r.found for r in items.collect()} == {"1": True, "2": False}


def test_digests(spark):
    schema = "notification_id string, owner_id string, urgency string, created_at timestamp, subject_kind string, subject string, title string, value string"
    at = datetime(2026, 8, 22, 1)
    waiting = spark.createDataFrame([("n1", "daily", "normal", at, "act", "1", "A", "k"), ("n2", "daily", "critical", at, "act", "1", "B", "k"), ("n3", "none", "normal", at, "act", "1", "C", "k"), ("n4", "quiet", "normal", at, "act", "2", "D", "k")], schema)
    prefs = spark.createDataFrame([("daily", "daily", "Europe/Warsaw", 8, None, None, None), ("quiet", "immediate", "Europe/Warsaw", None, None, 0, 9)], "owner_id string, mode string, zone string, at_hour int, on_weekday int, quiet_from int, quiet_to int")
    last = spark.createDataFrame([], "owner_id string, closed_at timestamp")
    due = op.digests_due(waiting, prefs, last, F.lit("2026-08-22 05:30:00").cast("timestamp"))
    assert sorted(r.notification_id for r in due.collect()) == ["n2", "n3"]  # before eight; the critical one goes, as does what has no preference
    later = op.digests_due(waiting, prefs, last, F.lit("2026-08-22 07:30:00").cast("timestamp"))
    assert sorted(r.notification_id for r in later.collect()) == ["n1", "n2", "n3", "n4"]
    assert later.select("owner_id", "digest_id").distinct().count() == 3
    m = op.matters(later).where("title = 'B'").first()
    assert [n.notification_id for n in m.notifications] == ["n2", "n1"]
    mail = op.mails(op.matters(later.withColumn("title", F.lit("<i>"))), F.lit("u")).first()
    assert mail.subject.endswith("1 sprawa") and "&lt;i&gt;" in mail.html and "* <i>\n  Pasuje do: k" in mail.text


def test_deliveries(spark):
    digests = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "a")], "digest_id string, owner_id string")
    sent = spark.createDataFrame([("4", "sent"), ("1", "failed")], "digest_id string, status string")
    users = spark.createDataFrame([("a", "A@x.pl"), ("b", " B@x.pl")], "user_id string, email string")
    off = spark.createDataFrame([("b@X.pl ", "bounced")], "address string, reason string")
    got = {r.digest_id: (r.status, r.detail) for r in op.delivery_outcomes(digests, sent, users, off).collect()}
    assert got == {"1": ("sent", None), "2": ("suppressed", "bounced"), "3": ("failed", "no such account"), "4": ("skipped", None)}
