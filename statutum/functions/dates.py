"""Dates: tolerant parsing, overlaps, digest windows in the owner's zone, quiet hours, job backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import first_that_holds, lookup

# Terms written as Roman numerals.
ROMAN = {
    "I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10,
    "XI": 11, "XII": 12, "XIII": 13, "XIV": 14, "XV": 15, "XVI": 16, "XVII": 17, "XVIII": 18, "XIX": 19, "XX": 20,
}


def iso_date(text: Column) -> Column:
    """``yyyy-MM-dd``; anything else is null."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def day_first_date(text: Column) -> Column:
    """``dd-MM-yyyy``; anything else is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"\A\d{2}-\d{2}-\d{4}\z"), F.try_to_date(trimmed, "dd-MM-yyyy"))


def minute_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` as the register prints it; anything else is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}\z"), F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd HH:mm")))


def iso_timestamp(text: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` with optional fraction, read in the session's zone (UTC); anything else is null."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?\z"), F.try_to_timestamp(text))


def tolerant_date(text: Column) -> Column:
    """A day out of any of the forms that the sources use."""
    return F.coalesce(iso_date(text), day_first_date(text), minute_timestamp(text).cast("date"), iso_timestamp(text).cast("date"))


def roman_term(text: Column) -> Column:
    return lookup(F.upper(F.trim(text)), ROMAN)


def comma_list(text: Column) -> Column:
    """Trimmed parts between commas, without empty ones; null gives none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def overlaps(start: Column, end: Column, window_from: Column, window_to: Column) -> Column:
    """Whether [start, end] meets [from, to]; an open end goes on for ever, without a start there is nothing."""
    return F.coalesce((start <= window_to) & (F.coalesce(end, F.lit("9999-12-31").cast("date")) >= window_from), F.lit(False))


def digest_boundary(mode: Column, zone: Column, at_hour: Column, on_weekday: Column, now: Column) -> Column:
    """The latest instant at or before ``now`` at which a digest of this kind closes, in the zone of its owner.

    ``on_weekday`` is 1 for Monday to 7. Immediate digests have none (null). Hours that the clock skips move forward as the
    session's calendar does.
    """
    local = F.from_utc_timestamp(now, zone)
    hour = F.date_trunc("hour", local)
    day = F.date_trunc("day", local)
    hours = lambda h: F.make_dt_interval(hours=h)
    days = lambda d: F.make_dt_interval(days=d)
    today = day + hours(at_hour)
    daily = F.when(today > hour, today - days(F.lit(1))).otherwise(today)
    this_week = today + days((on_weekday - F.weekday(local) - 1).cast("int"))
    weekly = F.when(this_week > hour, this_week - days(F.lit(7))).otherwise(this_week)
    at = first_that_holds([(mode == "hourly", hour), (mode == "daily", daily), (mode == "weekly", weekly)])
    return F.to_utc_timestamp(at, zone)


def window_closed(mode: Column, zone: Column, at_hour: Column, on_weekday: Column, now: Column, since: Column) -> Column:
    """Whether a boundary has passed since the last digest; immediate ones wait for none."""
    return F.when(mode == "immediate", True).otherwise(F.coalesce(digest_boundary(mode, zone, at_hour, on_weekday, now) > since, F.lit(False)))


def is_quiet(quiet_from: Column, quiet_to: Column, zone: Column, now: Column) -> Column:
    """Whether the owner's clock is inside [from, to), which may go over midnight; no hours, no quiet."""
    h = F.hour(F.from_utc_timestamp(now, zone))
    inside = F.when(quiet_from < quiet_to, (h >= quiet_from) & (h < quiet_to)).otherwise((h >= quiet_from) | (h < quiet_to))
    return F.coalesce(inside, F.lit(False))


def backoff_bounds(attempts: Column, first_s: int = 5, most_s: int = 3600) -> tuple[Column, Column]:
    """Least and most seconds before the next try: half of a window that doubles with each attempt up to a bound."""
    window = F.least(F.lit(first_s) * F.pow(F.lit(2.0), F.least(attempts, F.lit(10))), F.lit(float(most_s)))
    return window / 2, window


def page_count(total: Column, page_size: Column) -> Column:
    return F.when(total > 0, F.ceil(total / page_size)).otherwise(F.lit(0)).cast("long")


def trailing_number(text: Column) -> Column:
    """The number at the end of a heading, 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)\s*$", 1).try_cast("long"), F.lit(0).cast("long"))
