"""Acts, drafts, citations and stages: projections of parsed documents, timelines, medians, statuses and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import publisher_of, stable_id
from ..functions.vocabulary import UNKNOWN_STAGE, expected_next, move_is_allowed, reference_labels

#: Completed stays that a median needs; medians after which a draft counts as stalled.
ENOUGH, STALL_FACTOR = 5, 2


def midnight(day: Column) -> Column:
    return day.cast("timestamp")


def stage_timeline(stages: DataFrame) -> DataFrame:
    """Periods of ``stages(draft_id, ordinal, day, stage)``: ``draft_id, ordinal, stage, valid_from, valid_to``.

    Undated rows go. A stage lasts until the next one begins, but a day at least; the last is open (null). A stage without
    a name is the unknown one.
    """
    order = Window.partitionBy("draft_id").orderBy("day", "ordinal")
    following = F.lead("day").over(order)
    until = F.when(following.isNotNull(), F.greatest(following, F.date_add("day", 1)))
    return stages.where("day is not null").select("draft_id", "ordinal", F.coalesce("stage", F.lit(UNKNOWN_STAGE)).alias("stage"), midnight(F.col("day")).alias("valid_from"), midnight(until).alias("valid_to"))


def with_exceptions(timeline: DataFrame, moves: list[tuple[str, str]] | None = None, unknown: str = UNKNOWN_STAGE) -> DataFrame:
    """The timeline with ``exception``: whether a stage may not follow the one before it. Shares the timeline's shuffle."""
    before = F.lag("stage").over(Window.partitionBy("draft_id").orderBy("valid_from", "ordinal"))
    return timeline.withColumn("before_", before).withColumn("exception", ~move_is_allowed(F.col("before_"), F.col("stage"), moves, unknown)).drop("before_")


def current_stage(history: DataFrame) -> DataFrame:
    """The stage each draft is in: the latest to begin, then the highest ordinal; of several statements the earliest known."""
    order = [F.col("valid_from").desc(), F.col("ordinal").desc(), F.col("known_at").asc(), F.col("valid_to").asc_nulls_last()]
    place = F.row_number().over(Window.partitionBy("draft_id").orderBy(*order))
    return history.withColumn("place_", place).where("place_ = 1").select("draft_id", "stage", F.col("valid_from").alias("since"), "ordinal")


def as_of(history: DataFrame, day: Column, known: Column) -> DataFrame:
    """Stages that held on a day as far as was known at a moment; restatements may overlap, so several may hold."""
    return history.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)) & (F.col("known_at") <= known))


def as_of_asks(history: DataFrame, asks: DataFrame, days: int = 32) -> DataFrame:
    """For each of ``asks(draft_id, day, known)`` the stages that held on its day as far as was known at its moment: ``ask columns, stage, valid_from``.

    An interval stands in every bin of ``days`` days that it touches, up to the last day asked for, and an ask in the bin of its day, so the join is on equality of draft and
    bin, a draft with very many rows is dealt by bins, and a pair meets once. Bounds and knowledge are compared within the bin. Asks without an answer have no row.
    """
    last = asks.agg(F.max("day").cast("date")).first()[0]
    of = lambda day: F.floor(F.unix_date(day.cast("date")) / days)
    until = F.least(F.coalesce(F.col("valid_to").cast("date"), F.lit(last)), F.lit(last))
    lying = history.where(F.col("valid_from").cast("date") <= F.lit(last)).select(F.col("draft_id").alias("of_"), "stage", "valid_from", "valid_to", "known_at", F.explode(F.sequence(of(F.col("valid_from")), F.greatest(of(until), of(F.col("valid_from"))))).alias("bin_"))
    asked = asks.withColumn("bin_", of(F.col("day")))
    met = asked.join(lying, (asked["draft_id"] == lying["of_"]) & (asked["bin_"] == lying["bin_"]))
    held = met.where((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day"))) & (F.col("known_at") <= F.col("known")))
    return held.select(*asks.columns, "stage", "valid_from")


def stays(timeline: DataFrame, drafts: DataFrame) -> DataFrame:
    """``initiator, stage, seconds`` of completed stays."""
    done = timeline.where("valid_to is not null").select("draft_id", "stage", F.timestamp_diff("SECOND", F.col("valid_from"), F.col("valid_to")).alias("seconds"))
    return done.join(drafts.select("draft_id", "initiator"), "draft_id").select("initiator", "stage", "seconds")


def stage_paces(stays: DataFrame, times: str | None = None) -> DataFrame:
    """Exact medians in whole seconds by (initiator, stage) and by stage, from one aggregation over grouping sets.

    Stays are counted by value first, so what meets in a group is one row for each distinct length (whole days), not for each
    stay; with ``times`` they come counted, in that column. Columns: ``initiator`` (null in the rows of all initiators), ``overall, stage, median_seconds, n``.
    """
    counted = stays.groupBy("initiator", "stage", "seconds").agg((F.sum(times) if times else F.count(F.lit(1))).alias("k"))
    sets = counted.groupingSets([[F.col("initiator"), F.col("stage")], [F.col("stage")]], "initiator", "stage").agg(
        F.grouping("initiator").cast("boolean").alias("overall"),
        F.percentile("seconds", 0.5, F.col("k")).cast("long").alias("median_seconds"),
        F.sum("k").alias("n"),
    )
    return sets.select("initiator", "overall", "stage", "median_seconds", "n")


def pace_or_fallback(drafts: DataFrame, paces: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """``drafts(.., initiator, stage)`` with ``pace``: its initiator's median if enough stays are behind it, else that of all, else null.

    Medians are gathered into one row for each stage (initiators are few), so that drafts are joined once and medians computed once.
    """
    own = F.when(~F.col("overall") & F.col("initiator").isNotNull(), F.struct("initiator", "median_seconds"))
    by_stage = paces.where(F.col("n") >= enough).groupBy("stage").agg(F.max(F.when(F.col("overall"), F.col("median_seconds"))).alias("all_"), F.map_from_entries(F.collect_list(own)).alias("own_"))
    joined = drafts.join(by_stage, "stage", "left")
    return joined.withColumn("pace", F.coalesce(F.try_element_at("own_", F.col("initiator")), "all_")).drop("own_", "all_")


def draft_status(drafts: DataFrame, history: DataFrame, paces: DataFrame, acts: DataFrame, now: Column, next_stage=expected_next) -> DataFrame:
    """Where each draft stands; drafts without history have no row.

    ``drafts(draft_id, initiator, act_id, closed_at)``, ``history(draft_id, stage, ordinal, valid_from, valid_to, known_at)``,
    ``acts(act_id, in_force_from)``. The next stage and its expected date are null once closed; the deadline is the act's first
    day in force; ``stalled_since`` is set where an open draft has stayed twice its pace.
    """
    standing = current_stage(history).join(drafts, "draft_id").join(acts.select("act_id", "in_force_from"), "act_id", "left")
    paced = pace_or_fallback(standing, paces)
    closed = F.col("closed_at").isNotNull()
    following = F.when(~closed, next_stage(F.col("stage")))
    after = lambda n: F.timestamp_add("SECOND", F.col("pace") * n, F.col("since"))
    limit = after(STALL_FACTOR)
    deadline = midnight(F.col("in_force_from"))
    return paced.select(
        "draft_id",
        "initiator",
        F.col("stage").alias("current_stage"),
        "since",
        following.alias("next_stage"),
        F.when(following.isNotNull(), after(1)).alias("expected_at"),
        deadline.alias("deadline"),
        F.when(deadline.isNotNull(), "wejscie_w_zycie").alias("deadline_kind"),
        F.when(~closed & (limit < now), limit).alias("stalled_since"),
    )


def stage_counts(status: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Drafts and stalled drafts by current stage; stages that are not known are left out."""
    return status.where(F.col("current_stage").isin(*known)).groupBy("current_stage").agg(F.count(F.lit(1)).alias("drafts"), F.count_if(F.col("stalled_since").isNotNull()).alias("stalled"))


def orient_edges(references: DataFrame) -> DataFrame:
    """Edges of ``references(eli, label, target)``: ``from_eli, to_eli, relation``, labels mapped, ends swapped where the label says so.

    Unmapped labels, edges of an act to itself and repeats go.
    """
    labels = F.broadcast(reference_labels(references.sparkSession))  # ten rows
    swapped = F.col("direction") == "to"
    edges = references.join(labels, "label").select(F.when(swapped, F.col("target")).otherwise(F.col("eli")).alias("from_eli"), F.when(swapped, F.col("eli")).otherwise(F.col("target")).alias("to_eli"), "relation")
    return edges.where("from_eli <> to_eli").distinct()


def unmapped_labels(references: DataFrame) -> DataFrame:
    labels = F.broadcast(reference_labels(references.sparkSession).select("label"))
    return references.join(labels, "label", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def citations(edges: DataFrame, acts: DataFrame, outwards: bool) -> DataFrame:
    """What each act cites, or with ``outwards`` false what cites it: ``eli, relation, other_eli, title, announced_on``.

    Acts that are not held stay, without title. ``place`` counts newest first, undated last.
    """
    own, other = ("from_eli", "to_eli") if outwards else ("to_eli", "from_eli")
    held = acts.where("eli is not null").select(F.col("eli").alias(other), "title", "announced_on")
    joined = edges.join(held, other, "left").select(F.col(own).alias("eli"), "relation", F.col(other).alias("other_eli"), "title", "announced_on")
    order = Window.partitionBy("eli").orderBy(F.col("announced_on").desc_nulls_last(), "other_eli", "relation")
    return joined.withColumn("place", F.row_number().over(order))


def source_drafts(drafts: DataFrame) -> DataFrame:
    """The draft that became each act: the first created of those linked to it."""
    linked = drafts.where("act_id is not null")
    return linked.groupBy("act_id").agg(F.min(F.struct("created_at", "draft_id")).alias("d")).select("act_id", F.col("d.draft_id").alias("draft_id"))


def act_cards(acts: DataFrame, identifiers: DataFrame, edges: DataFrame, drafts: DataFrame) -> DataFrame:
    """A card for each act: days between announcement and force, citations both ways newest first, identifiers sorted, its draft.

    Two citation lists are grouped before the join, so an act that thousands cite has one row on each side.
    """
    def listed(outwards: bool, name: str) -> DataFrame:
        rows = citations(edges, acts, outwards)
        return rows.groupBy("eli").agg(F.array_sort(F.collect_list(F.struct("place", "relation", "other_eli", "title", "announced_on"))).alias(name))

    named = identifiers.groupBy("act_id").agg(F.array_sort(F.collect_set(F.struct("scheme", "value"))).alias("identifiers"))
    cards = acts.withColumn("vacatio_days", F.datediff("in_force_from", "announced_on"))
    return cards.join(listed(True, "cites"), "eli", "left").join(listed(False, "cited_by"), "eli", "left").join(named, "act_id", "left").join(source_drafts(drafts).withColumnRenamed("draft_id", "source_draft"), "act_id", "left")


def draft_cards(drafts: DataFrame, status: DataFrame, history: DataFrame) -> DataFrame:
    """A card for each draft: its status, if it has one, and its history in order."""
    told = history.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("valid_from", "ordinal", "known_at", "stage", "valid_to"))).alias("history"))
    return drafts.join(status.drop("initiator"), "draft_id", "left").join(told, "draft_id", "left")


def acts_of(parsed: DataFrame) -> DataFrame:
    """Acts from ``parsed(eli, title, act_type, announced_on, in_force_from)``; an act's id depends on its address alone."""
    return parsed.where("eli is not null").select(stable_id(F.lit("act"), F.col("eli")).alias("act_id"), "eli", "title", "act_type", publisher_of(F.col("eli")).alias("publisher"), "announced_on", "in_force_from")


def act_identifiers(parsed: DataFrame) -> DataFrame:
    """``act_id, scheme, value, confidence, method``: an act's address and the prints it was made from, all exact."""
    act = stable_id(F.lit("act"), F.col("eli"))
    own = parsed.where("eli is not null").select(act.alias("act_id"), F.lit("eli").alias("scheme"), F.col("eli").alias("value"))
    prints = parsed.where("eli is not null").select(act.alias("act_id"), F.explode("prints").alias("value")).select("act_id", F.lit("druk_sejmowy").alias("scheme"), "value")
    return own.unionByName(prints).distinct().withColumn("confidence", F.lit(1.0).cast("decimal(4,3)")).withColumn("method", F.lit("exact"))


def drafts_of(parsed: DataFrame) -> DataFrame:
    """Drafts from ``parsed(address, title, initiator, started_on, closed_on, outcome, eli)`` with stable ids and the act they became."""
    act = F.when(F.col("eli").isNotNull(), stable_id(F.lit("act"), F.col("eli")))
    return parsed.select(stable_id(F.lit("draft"), F.col("address")).alias("draft_id"), "title", "initiator", "started_on", midnight(F.col("closed_on")).alias("closed_at"), "outcome", act.alias("act_id"), "address")


def stage_facts(parsed: DataFrame, known_at: Column) -> DataFrame:
    """Stage facts of ``parsed(address, stages array<struct<ordinal, day, stage>>)`` with exceptions, as known at a moment."""
    rows = parsed.select(stable_id(F.lit("draft"), F.col("address")).alias("draft_id"), F.explode("stages").alias("s")).select("draft_id", "s.ordinal", "s.day", "s.stage")
    return with_exceptions(stage_timeline(rows)).withColumn("known_at", known_at)


def government_facts(cards: DataFrame, known_at: Column) -> DataFrame:
    """The one fact that a project card states: an open government stage since the card's creation."""
    dated = cards.where("created_on is not null")
    return dated.select(stable_id(F.lit("rcl"), F.col("project_id")).alias("draft_id"), F.lit(0).alias("ordinal"), F.lit("proces_rzadowy").alias("stage"), midnight(F.col("created_on")).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(False).alias("exception"), known_at.alias("known_at"))


def linkage(documents: DataFrame, identifiers: DataFrame) -> DataFrame:
    """For prints and acts: documents that could be linked, links made, and their ratio."""
    scheme = F.when(F.col("kind") == "print", "druk_sejmowy").when(F.col("kind") == "act", "eli")
    could = documents.where(scheme.isNotNull()).groupBy(scheme.alias("scheme")).agg(F.count(F.lit(1)).alias("matchable"))
    linked = identifiers.groupBy("scheme").agg(F.count(F.lit(1)).alias("linked"))
    return could.join(linked, "scheme", "left").select("scheme", "matchable", F.coalesce("linked", F.lit(0)).alias("linked")).withColumn("ratio", F.col("linked") / F.col("matchable"))
