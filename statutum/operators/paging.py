"""Orders, limits and pages; every order ends with a unique column, so that pages neither repeat nor drop rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, time: str, unique: str, limit: int, most: int = 1000) -> DataFrame:
    """The newest rows; runs as a top-k in each partition."""
    return rows.orderBy(F.col(time).desc_nulls_last(), F.col(unique).desc()).limit(min(max(limit, 1), most))


def after(rows: DataFrame, key: str, last: object | None, limit: int) -> DataFrame:
    """The next page by key. In Spark a whole table is better read at once than in pages; this serves callers that page."""
    rest = rows if last is None else rows.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def page(rows: DataFrame, order: list[Column], offset: int, size: int, most: int = 100) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, size), most))


def where_given(rows: DataFrame, **conditions: object) -> DataFrame:
    """Rows equal to every argument that is given; an argument of None is no condition, a list means any of it."""
    for column, value in conditions.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.where(F.col(column).isin(*value)) if value else rows
        elif value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def owned_by(rows: DataFrame, owner: str) -> DataFrame:
    """An owner's rows; those of others look as if they were not there."""
    return rows.where(F.col("owner_id") == owner)


def can_rename(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """Renames ``(profile_id, owner_id, name)`` that no other profile of the owner stands in the way of."""
    others = profiles.select(F.col("profile_id").alias("other_id"), F.col("owner_id").alias("other_owner"), F.col("name").alias("other_name"))
    clash = (F.col("owner_id") == F.col("other_owner")) & (F.col("name") == F.col("other_name")) & (F.col("profile_id") != F.col("other_id"))
    return wanted.join(others, clash, "left_anti")


def profile_versions(profiles: DataFrame, revisions: DataFrame) -> DataFrame:
    """Profiles after revisions: the current version is the highest that was written; all versions stay in the interests."""
    last = revisions.groupBy("profile_id").agg(F.max("version").alias("revised"))
    return profiles.join(last, "profile_id", "left").withColumn("current_version", F.greatest("current_version", F.coalesce("revised", F.lit(0)))).drop("revised")
