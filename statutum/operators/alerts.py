"""Alerts: pending items, decisions with cooldown, digests and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import is_quiet, window_closed
from ..functions.folds import running
from ..functions.ids import case_key, email_address, event_key, stable_id
from ..functions.text import escape_html, plural_of_matters
from ..functions.vocabulary import specificity

#: Seconds in which one matter is raised once; items of a pass; passes of a run.
COOLDOWN_S, PASS_ITEMS, PASSES = 24 * 3600, 200, 25

# Wording of mails.
HEADING, REASON, LEAVE_TEXT, LEAVE_LINK = "Co się wydarzyło", "Pasuje do: ", "Nie chcesz tych wiadomości? ", "Zrezygnuj z tych wiadomości"


def add_pending(pending: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Items to add to the buffer: those that do not wait already, one for each (kind, subject), the first to arrive."""
    waiting = pending.where("processed_at is null").select("kind", "subject").distinct()
    first = arrivals.groupBy("kind", "subject").agg(F.min("arrived_at").alias("arrived_at"))
    return first.join(waiting, ["kind", "subject"], "left_anti").withColumn("processed_at", F.lit(None).cast("timestamp"))


def next_pass(pending: DataFrame, items: int = PASS_ITEMS) -> DataFrame:
    """The oldest items that wait."""
    return pending.where("processed_at is null").orderBy("arrived_at", "kind", "subject").limit(items)


def run_passes(pending: DataFrame, items: int = PASS_ITEMS, passes: int = PASSES) -> DataFrame:
    """What one run judges, with ``pass_no``: the oldest items that wait, so many of them in each of so many passes.

    A pass marks its items as processed before the next begins; what waits beyond the last pass is left to the next run.
    """
    taken = next_pass(pending, items * passes)  # a bounded number of rows
    place = F.row_number().over(Window.orderBy("arrived_at", "kind", "subject")) - 1
    return taken.withColumn("pass_no", F.floor(place / items) + 1)


def resolve_items(pending: DataFrame, acts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Pending items with title, address and stage; ``found`` is false for ids that name nothing, which count as judged too."""
    a = acts.select(F.lit("act").alias("kind"), F.col("act_id").alias("subject"), "title", "eli", F.lit(None).cast("string").alias("stage"))
    d = drafts.select(F.lit("draft").alias("kind"), F.col("draft_id").alias("subject"), "title", F.lit(None).cast("string").alias("eli"), "stage")
    return pending.join(a.unionByName(d), ["kind", "subject"], "left").withColumn("found", F.col("title").isNotNull())


def best_reason(caught: DataFrame) -> DataFrame:
    """The most specific interest for each item and profile; ties go to the smaller value."""
    order = Window.partitionBy("item_id", "profile_id").orderBy(specificity(F.col("kind")), "value")
    return caught.withColumn("place_", F.row_number().over(order)).where("place_ = 1").drop("place_")


def watches(stages: Column, stage: Column) -> Column:
    """A rule without stages watches all; an item without a stage is watched by all."""
    return stages.isNull() | (F.size(stages) == 0) | stage.isNull() | F.array_contains(stages, stage)


def rules_with_stages(rules: DataFrame, stages: DataFrame) -> DataFrame:
    return rules.join(stages.groupBy("rule_id").agg(F.collect_set("stage").alias("stages")), "rule_id", "left")


def standing_reasons(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """What a profile's rule says, before anything that was raised earlier: ``verdict`` is null where the rule wants it."""
    joined = candidates.join(rules.select("profile_id", "rule_id", "enabled", "urgency", "stages"), "profile_id", "left")
    verdict = F.when(F.col("rule_id").isNull(), "no_rule").when(~F.col("enabled"), "rule_disabled").when(~watches(F.col("stages"), F.col("stage")), "stage_not_watched")
    return joined.withColumn("verdict", verdict)


def raised_in_order(times: Column, before: Column, cooldown: int = COOLDOWN_S) -> Column:
    """Which of ascending seconds are raised if each has to be more than ``cooldown`` after the one raised last; a fold."""
    due = lambda last, t: last.isNull() | (t - last > cooldown)
    said = running(times, before.cast("long"), lambda last, t: F.when(due(last, t), t).otherwise(last), lambda last, t: F.when(due(last, t), t), "bigint")
    return F.filter(said, lambda t: t.isNotNull())


def cooldown(events: DataFrame, seconds: int = COOLDOWN_S) -> DataFrame:
    """Events ``(owner_id, case_key, at seconds, event_id)`` with ``raised``: those more than the cooldown after the last one raised.

    Equal times of a matter are one moment, of which the smallest event id is raised. Only the distinct times of a matter
    are gathered in one array; all its other columns stay in their rows. Rows are joined back by matter and time.
    """
    at_once = events.groupBy("owner_id", "case_key", "at").agg(F.min("event_id").alias("first_id"))
    folded = at_once.groupBy("owner_id", "case_key").agg(F.array_sort(F.collect_list("at")).alias("times"))
    raised = folded.select("owner_id", "case_key", F.explode(raised_in_order(F.col("times"), F.lit(None), seconds)).alias("at"))
    chosen = raised.join(at_once, ["owner_id", "case_key", "at"]).select("owner_id", "case_key", "at", F.col("first_id").alias("event_id"), F.lit(True).alias("raised"))
    return events.join(chosen, ["owner_id", "case_key", "at", "event_id"], "left").withColumn("raised", F.coalesce("raised", F.lit(False)))


def decide(candidates: DataFrame, rules: DataFrame, notifications: DataFrame, seconds: int = COOLDOWN_S) -> DataFrame:
    """A decision for each candidate: ``reason`` in the order no_rule, rule_disabled, stage_not_watched, case_recently_raised, already_told, matched.

    ``candidates(item_id, owner_id, profile_id, version, kind, value, subject_kind, subject, stage, title, at)``, ``at`` in seconds;
    ``notifications(owner_id, case_key, event_key, at)`` raised before. Within a matter of an owner, candidates are judged in
    order of time, then profile and item: a candidate is recent if one was raised in the ``seconds`` before or at its time, and
    told if its event was raised at all. The state of a matter is the last time and the events raised, folded over its
    candidates; matters are independent and small, being one owner's news of one act or draft.
    """
    judged = standing_reasons(candidates, rules)
    judged = judged.withColumn("case_key", case_key(F.col("subject_kind"), F.col("subject"))).withColumn("event_key", event_key(F.col("subject_kind"), F.col("subject"), F.col("stage")))
    open_ = judged.where("verdict is null")
    past = notifications.groupBy("owner_id", "case_key").agg(F.max("at").alias("last"), F.collect_set("event_key").alias("told"))
    line = F.struct("at", "profile_id", "item_id", "event_key")
    matters = open_.groupBy("owner_id", "case_key").agg(F.array_sort(F.collect_list(line)).alias("line")).join(past, ["owner_id", "case_key"], "left")
    start = F.struct(F.col("last").cast("long").alias("last"), F.coalesce("told", F.array().cast("array<string>")).alias("told"))
    recent = lambda acc, c: acc["last"].isNotNull() & (c["at"] - acc["last"] <= seconds)
    told = lambda acc, c: F.array_contains(acc["told"], c["event_key"])

    def step(acc: Column, c: Column) -> Column:
        return F.when(recent(acc, c) | told(acc, c), acc).otherwise(F.struct(c["at"].alias("last"), F.array_append(acc["told"], c["event_key"]).alias("told")))

    def emit(acc: Column, c: Column) -> Column:
        reason = F.when(recent(acc, c), "case_recently_raised").when(told(acc, c), "already_told").otherwise("matched")
        return F.struct(c["profile_id"].cast("string").alias("profile_id"), c["item_id"].cast("string").alias("item_id"), reason.alias("reason"))

    lines = running(F.col("line"), start, step, emit, "struct<profile_id:string,item_id:string,reason:string>")
    said = matters.select("owner_id", "case_key", F.explode(lines).alias("o"))
    said = said.select(F.col("owner_id").alias("o"), F.col("o.profile_id").alias("p"), F.col("o.item_id").alias("i"), F.col("o.reason").alias("reason"))
    done = judged.where("verdict is not null").withColumn("reason", F.col("verdict"))
    here = open_.join(said, (F.col("owner_id") == F.col("o")) & (F.col("profile_id").cast("string") == F.col("p")) & (F.col("item_id").cast("string") == F.col("i")))
    all_ = here.drop("o", "p", "i").unionByName(done).drop("verdict", "stages")
    return all_.withColumn("decision", F.when(F.col("reason") == "matched", "raised").otherwise("withheld"))


def new_notifications(decisions: DataFrame) -> DataFrame:
    """Notifications of raised decisions: ids depend on owner and event, of which there is one for ever."""
    raised = decisions.where("decision = 'raised'")
    return raised.select(stable_id(F.col("owner_id"), F.col("event_key")).alias("notification_id"), "owner_id", "profile_id", "version", "subject_kind", "subject", "title", "case_key", "event_key", "kind", "value", "urgency", "at")


def exactly_once(events: DataFrame) -> DataFrame:
    """The first event ``(owner_id, event_key, at, event_id)`` of each owner and key, for ever."""
    return events.groupBy("owner_id", "event_key").agg(F.min(F.struct("at", "event_id")).alias("f")).select("owner_id", "event_key", "f.at", "f.event_id")


def with_preferences(owners: DataFrame, preferences: DataFrame) -> DataFrame:
    """Delivery preferences; an owner without any hears at once, in Warsaw time, without quiet hours."""
    joined = owners.join(preferences, "owner_id", "left")
    return joined.withColumn("mode", F.coalesce("mode", F.lit("immediate"))).withColumn("zone", F.coalesce("zone", F.lit("Europe/Warsaw")))


def digests_due(waiting: DataFrame, preferences: DataFrame, last_digests: DataFrame, now: Column) -> DataFrame:
    """Notifications that go out now, with ``digest_id``: one digest for each owner of any.

    Critical ones go always; others if the owner's window has closed since the last digest, or, without one, since the oldest
    that waits, and the owner's hours are not quiet.
    """
    oldest = waiting.groupBy("owner_id").agg(F.min("created_at").alias("oldest"))
    owners = with_preferences(oldest, preferences).join(last_digests.groupBy("owner_id").agg(F.max("closed_at").alias("last")), "owner_id", "left")
    since = F.coalesce("last", "oldest")
    opened = window_closed(F.col("mode"), F.col("zone"), F.col("at_hour"), F.col("on_weekday"), now, since) & ~is_quiet(F.col("quiet_from"), F.col("quiet_to"), F.col("zone"), now)
    owners = owners.select("owner_id", opened.alias("opened"))
    going = waiting.join(owners, "owner_id").where((F.col("urgency") == "critical") | F.col("opened"))
    return going.withColumn("digest_id", stable_id(F.lit("digest"), F.col("owner_id"), F.unix_micros(now.cast("timestamp")))).drop("opened")


def matters(notifications: DataFrame) -> DataFrame:
    """A digest by matter: newest title and time, and its notifications newest first."""
    return notifications.groupBy("digest_id", "subject_kind", "subject").agg(
        F.max_by("title", F.struct("created_at", "notification_id")).alias("title"),
        F.max("created_at").alias("latest"),
        F.sort_array(F.collect_list(F.struct("created_at", "notification_id", "value")), asc=False).alias("notifications"),
    )


def mails(matters: DataFrame, unsubscribe_url: Column, sender: str = "Statutum") -> DataFrame:
    """``digest_id, subject, text, html`` of each digest, its matters newest first; titles are escaped in the HTML."""
    listed = matters.groupBy("digest_id").agg(F.sort_array(F.collect_list(F.struct("latest", "subject_kind", "subject", "title", F.col("notifications")[0]["value"].alias("reason"))), asc=False).alias("m"))
    n = F.size("m")
    reason = lambda m: F.concat(F.lit(REASON), m["reason"])
    text = F.array_join(F.transform("m", lambda m: F.concat(F.lit("* "), m["title"], F.lit("\n  "), reason(m), F.lit("\n\n"))), "")
    html = F.array_join(F.transform("m", lambda m: F.concat(F.lit("<li><strong>"), escape_html(m["title"]), F.lit("</strong><br><small>"), escape_html(reason(m)), F.lit("</small></li>"))), "")
    return listed.select(
        "digest_id",
        F.concat(F.lit(f"{sender}: "), n.cast("string"), F.lit(" "), plural_of_matters(n)).alias("subject"),
        F.concat(F.lit(f"{HEADING}:\n\n"), text, F.lit(LEAVE_TEXT), unsubscribe_url, F.lit("\n")).alias("text"),
        F.concat(F.lit(f"<h1>{HEADING}</h1><ul>"), html, F.lit('</ul><p><a href="'), escape_html(unsubscribe_url), F.lit(f'">{LEAVE_LINK}</a></p>')).alias("html"),
    )


def delivery_outcomes(digests: DataFrame, deliveries: DataFrame, users: DataFrame, suppressions: DataFrame) -> DataFrame:
    """What becomes of each digest ``(digest_id, owner_id)``: skipped if sent before, failed without an account, suppressed, else sent."""
    sent = deliveries.where("status = 'sent'").select("digest_id", F.lit(True).alias("sent")).distinct()
    refused = suppressions.select(email_address(F.col("address")).alias("address_"), F.col("reason").alias("refusal")).groupBy("address_").agg(F.min("refusal").alias("refusal"))
    rows = digests.join(sent, "digest_id", "left").join(users.select(F.col("user_id").alias("owner_id"), email_address(F.col("email")).alias("address_")), "owner_id", "left").join(refused, "address_", "left")
    status = F.when(F.col("sent"), "skipped").when(F.col("address_").isNull(), "failed").when(F.col("refusal").isNotNull(), "suppressed").otherwise("sent")
    detail = F.when(status == "failed", "no such account").when(status == "suppressed", F.col("refusal"))
    return rows.select("digest_id", "owner_id", F.coalesce("address_", F.lit("")).alias("address"), status.alias("status"), detail.alias("detail"))


def delivery_counts(deliveries: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Deliveries by status and suppressed addresses by reason."""
    a = deliveries.groupBy(F.lit("delivery").alias("what"), F.col("status").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(suppressions.groupBy(F.lit("suppression").alias("what"), F.col("reason").alias("value")).agg(F.count(F.lit(1)).alias("n")))
