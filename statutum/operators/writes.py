"""Writes as set operations: what a table holds after inserts and updates, computed from all statements made about each key.

Choosing one row for each key is a ``row_number() = 1`` filter: Spark limits each group before the shuffle, so a key with any
number of statements sends one row for each task. Ties in the order are settled by all other columns, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; equal keys compare null-safely."""
    rest = [F.col(c) for c in rows.columns if c not in keys and not rows.schema[c].dataType.typeName() == "map"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return rows.withColumn("place_", place).where("place_ = 1").drop("place_")


def latest(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Last write wins: plain upserts, identifier repoints, preferences, suppressions, deliveries, cursors, statuses."""
    return one_per_key(rows, keys, [F.col(arrival).desc_nulls_last()])


def first_written(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """First write wins: insert or do nothing, exactly-once notifications, an owner's first token."""
    return one_per_key(rows, keys, [F.col(arrival).asc_nulls_last()])


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Rows of ``incoming`` to insert: the first of each key that ``existing`` lacks. Null keys are equal."""
    new = first_written(incoming, keys, arrival)
    held = existing.select(*[F.col(k).alias(f"{k}_") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return new.join(held, same, "left_anti")


def merge_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: an incoming row replaces the columns of the stored one, but for those in ``keep`` (id, creation, publisher)."""
    new = latest(incoming, keys, arrival).select(*existing.columns)
    joined = existing.alias("e").join(new.alias("n"), keys, "full_outer")
    known, sent = F.col(f"e.{arrival}").isNotNull(), F.col(f"n.{arrival}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        old, fresh = F.col(f"e.{c}"), F.col(f"n.{c}")
        kept = F.when(known, old).otherwise(fresh) if c in keep else F.when(sent, fresh).otherwise(old)
        return kept.alias(c)

    return joined.select(*[pick(c) for c in existing.columns])


def documents_of(sightings: DataFrame) -> DataFrame:
    """``source, external_id, title, kind`` from ``sightings(source, external_id, title, kind, arrival)``.

    The newest title that is not null stays; the kind is the first one stated. Both are combined before the shuffle.
    """
    return sightings.groupBy("source", "external_id").agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), F.struct("arrival", "title"))).alias("title"),
        F.min_by("kind", F.struct("arrival", "kind")).alias("kind"),
    )


def version_chain(sightings: DataFrame) -> DataFrame:
    """Versions of each document from ``sightings(document_id, content_hash, arrival)``.

    A hash counts where it was first seen, so that A, B, A are two versions. Columns: ``document_id, version_no,
    content_hash, previous_hash, first_seen``.
    """
    first = sightings.groupBy("document_id", "content_hash").agg(F.min("arrival").alias("first_seen"))
    order = Window.partitionBy("document_id").orderBy("first_seen", "content_hash")
    return first.select("document_id", F.row_number().over(order).alias("version_no"), "content_hash", F.lag("content_hash").over(order).alias("previous_hash"), "first_seen")


def replace_edges(edges: DataFrame) -> DataFrame:
    """The edges stated by the newest version of each act, from ``edges(stated_by, version_no, from_eli, to_eli, relation)``.

    Replaying an act deletes the edges that start at it, whoever stated them, and inserts what its newest version states. Edges
    that start at another act are left to that one. Acts whose newest version has no edge need a row with null ends.
    """
    newest = edges.groupBy("stated_by").agg(F.max("version_no").alias("version_no"))
    current = edges.join(newest, ["stated_by", "version_no"])
    return current.where("from_eli is not null and to_eli is not null and from_eli <> to_eli").select("from_eli", "to_eli", "relation").distinct()


def append_facts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stage facts to add, from rows ``(draft_id, stage, ordinal, valid_from, valid_to, known_at, exception)``.

    A fact is its draft, stage and period; an open period equals another open one. The earliest statement of a fact stays.
    Empty periods are refused.
    """
    sound = incoming.where("valid_from is not null and (valid_to is null or valid_to > valid_from)")
    return insert_absent(existing, sound, ["draft_id", "stage", "valid_from", "valid_to"], "known_at")


def set_where_null(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Fill ``column`` from ``changes(key, column)`` where it is null; a value once set stays. The least change wins."""
    wanted = changes.groupBy(key).agg(F.min(column).alias("set_"))
    return rows.join(wanted, key, "left").withColumn(column, F.coalesce(column, "set_")).select(*rows.columns)


def drop_unnumbered_proceedings(rows: DataFrame) -> DataFrame:
    """Without the proceedings of number 0, under which several sittings were once filed."""
    return rows.where(~F.coalesce(F.col("external_id").rlike(r"\Aterm[0-9]+/proceeding/0\z"), F.lit(False)))


def roles_of(users: DataFrame) -> DataFrame:
    """``user_id, role``: one row for each role in a comma-separated list, trimmed, without blanks."""
    return users.select("user_id", F.explode(F.split("roles", ",")).alias("role")).select("user_id", F.trim("role").alias("role")).where("role <> ''").distinct()


def roles_by_user(roles: DataFrame) -> DataFrame:
    """Roles as a sorted set for each user."""
    return roles.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
