"""Register of published acts: landed JSON to acts, their identifiers and references, and what a read takes.

An item without a sound address is a warning, not an act. Dates that cannot be read are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..functions.ids import is_eli, print_address
from ..functions.vocabulary import gazette_kind

ACT = "ELI string, title string, type string, promulgation string, announcementDate string, entryIntoForce string, changeDate string, prints array<struct<term:int,number:string>>, references map<string,array<struct<id:string,date:string>>>"
PAGE = "totalCount long, items array<string>"
UNSTATED_TYPE, LOOKBACK_DAYS = "nieokreślony", 14


def parsed_acts(documents: DataFrame) -> DataFrame:
    """``eli, title, act_type, announced_on, in_force_from, prints array<string>, references`` of payloads that are acts."""
    a = documents.select(F.from_json("payload", ACT).alias("a")).where(is_eli(F.col("a.ELI")) & (F.trim("a.title") != ""))
    numbered = F.filter(F.coalesce("a.prints", F.array().cast("array<struct<term:int,number:string>>")), lambda p: p["term"].isNotNull() & (F.trim(p["number"]) != ""))
    return a.select(
        F.col("a.ELI").alias("eli"),
        F.col("a.title").alias("title"),
        F.when(F.trim("a.type") != "", F.col("a.type")).otherwise(F.lit(UNSTATED_TYPE)).alias("act_type"),
        iso_date(F.col("a.promulgation")).alias("announced_on"),
        iso_date(F.col("a.entryIntoForce")).alias("in_force_from"),
        F.transform(numbered, lambda p: print_address(p["term"], p["number"])).alias("prints"),
        F.col("a.references").alias("references"),
    )


def references(acts: DataFrame) -> DataFrame:
    """``eli, label, target`` for every reference with a sound address."""
    by_label = acts.select("eli", F.explode("references").alias("label", "many"))
    return by_label.select("eli", "label", F.explode("many.id").alias("target")).where(is_eli(F.col("target")))


def classified(documents: DataFrame) -> DataFrame:
    kind = gazette_kind(F.col("external_id"))
    title, day = F.get_json_object("payload", "$.title"), F.get_json_object("payload", "$.promulgation")
    return documents.withColumn("kind", kind).withColumn("title", F.when(kind == "act", title)).withColumn("published_at", F.when(kind == "act", iso_date(day).cast("timestamp")))


def page_items(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of search pages ``(page_id, body)``: acts by address, and warnings for the others. All count as served.

    A page that states no total count is an error of the source and raises one in the job that reads it.
    """
    body = pages.select("page_id", F.from_json("body", PAGE).alias("b"))
    served = F.size(F.coalesce("b.items", F.array().cast("array<string>")))
    stated = F.coalesce("b.totalCount", F.raise_error(F.lit("a page without totalCount")).cast("long"))
    items = body.select("page_id", stated.alias("total_count"), served.alias("items_served"), F.explode("b.items").alias("payload"))
    items = items.withColumn("external_id", F.get_json_object("payload", "$.ELI"))
    sound = F.coalesce(is_eli(F.col("external_id")), F.lit(False))
    said = F.concat(F.lit("MISSING_FIELD:/acts/items[].ELI ("), F.coalesce("external_id", F.lit("no address")), F.lit(")"))
    return items.where(sound), items.where(~sound).select("page_id", said.alias("warning"))


def published_window(acts: DataFrame, published_through: Column, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Acts published since some days before the cursor: late ones are read again, and the archive drops what it has."""
    return acts.where(F.col("announced_on") >= F.date_sub(published_through, days))


def publishers_to_read(first_pages: DataFrame, known_change: Column) -> DataFrame:
    """``first_pages(publisher, changed_at, completed)`` by publisher: whether to read on, newest change, whether it answered.

    A publisher whose newest change on its first page is not after the known one is left alone.
    """
    newest = F.max("changed_at")
    return first_pages.groupBy("publisher").agg(newest.alias("newest"), F.bool_and("completed").alias("completed"), (F.bool_and("completed") & (known_change.isNull() | F.coalesce(newest > known_change, F.lit(False)))).alias("changed"))


def next_cursor(passes: DataFrame, published_through: Column, known_change: Column, today: Column) -> DataFrame:
    """The cursor after a read: the date moves on only if every publisher answered, the change stamp never back."""
    return passes.agg(
        F.when(F.bool_and("completed"), today).otherwise(published_through).alias("published_through"),
        F.greatest(F.max("newest"), known_change).alias("last_change"),
        (F.bool_and("completed") & ~F.bool_or("changed")).alias("source_unchanged"),
    )


def declared_volumes(pages: DataFrame) -> DataFrame:
    """How many acts a publisher says it has in a year, of ``pages(code, year, total_count)``, one or more pages each; binding."""
    total = pages.groupBy("code", "year").agg(F.max("total_count").cast("long").alias("declared"))
    partition = F.concat_ws("/", "code", F.col("year").cast("string"))
    return total.select(F.lit("isap").alias("source"), partition.alias("partition"), F.lit("act").alias("kind"), F.concat(partition, F.lit("/")).alias("prefix"), "declared", F.lit(True).alias("authoritative"))


def partitions(publishers: DataFrame, window_from: Column, window_to: Column) -> DataFrame:
    """Backfill partitions ``(code, year)`` of ``publishers(code, years)`` in a window, in order: newest year first, then code."""
    years = publishers.select("code", F.explode("years").alias("year")).where(F.col("year").between(F.year(window_from), F.year(window_to)))
    return years.orderBy(F.col("year").desc(), "code")
