"""Digests as one stream: owners' notifications in state, and a timer for the next instant at which something is to be decided.

Gives what ``operators.alerts.digests_due`` gives when it is asked at every full hour of the owner's clock: others than critical ones go out at the first such hour
that is not quiet and before which a boundary of the owner's mode (an hour, a day, a week) has passed since the owner's last digest or, without
one, since the oldest that waits. Critical ones, and those of owners who hear at once, go out as they arrive, unless, of the latter, the hour is quiet.

Time is event time. What arrives is put in order by being held until the watermark has passed it, so batches may be cut and mixed in any way
within the time that rows may be late; only rows that go out at once don't wait for that. An owner wakes at the earliest instant at which a row held comes
up or a digest closes, and never if nothing waits.

Owners share ``BUCKETS`` keys by a hash. A bucket's owners are one value of the state, read and written once in a batch, and have one timer, the earliest
at which one of them wakes: a batch costs some round trips for each bucket that it touches, not for each owner and row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SENT = "owner_id string, closed_at long, notification_id string, urgency string, created_at long"
#: Keys that owners share.
BUCKETS = 4096
#: Without stored preferences an owner hears at once, in this zone.
ZONE = "Europe/Warsaw"
HOUR = timedelta(hours=1)


def instant(naive: datetime, zone: ZoneInfo) -> datetime:
    """The instant of a time on the owner's clock; one that the clock skips moves forward, of one that comes twice it is the first."""
    return naive.replace(tzinfo=zone, fold=0).astimezone(timezone.utc)


def full_hour(at: datetime, zone: ZoneInfo) -> datetime:
    """The first full hour of the owner's clock that is not before an instant."""
    here = at.astimezone(zone)
    past = timedelta(minutes=here.minute, seconds=here.second, microseconds=here.microsecond)
    return at + (HOUR - past if past else past)


def next_boundary(mode: str, zone: ZoneInfo, at_hour: int, on_weekday: int, after: datetime) -> datetime:
    """The first boundary after an instant, as ``functions.dates.digest_boundary`` has them."""
    if mode == "hourly":
        at = full_hour(after + timedelta(microseconds=1), zone)
        while instant(at.astimezone(zone).replace(tzinfo=None), zone) != at:  # an hour that comes again is no boundary
            at += HOUR
        return at
    day = after.astimezone(zone).replace(tzinfo=None, hour=0, minute=0, second=0, microsecond=0)
    step = timedelta(days=1 if mode == "daily" else 7)
    if mode == "weekly":
        day += timedelta(days=on_weekday - day.isoweekday())
    at = day + timedelta(hours=at_hour) - step
    while instant(at, zone) <= after:
        at += step
    return instant(at, zone)


def quiet(quiet_from: int | None, quiet_to: int | None, zone: ZoneInfo, at: datetime) -> bool:
    """Whether the owner's clock is inside [from, to), which may go over midnight."""
    if quiet_from is None or quiet_to is None:
        return False
    h = at.astimezone(zone).hour
    return quiet_from <= h < quiet_to if quiet_from < quiet_to else h >= quiet_from or h < quiet_to


def closing(how: tuple, since: datetime, now: datetime) -> datetime | None:
    """The first full hour, not before ``now``, at which what waits goes out; none if the owner's quiet hours are all hours."""
    mode, zone, at_hour, on_weekday, quiet_from, quiet_to = how
    at = full_hour(now if mode == "immediate" else max(now, next_boundary(mode, zone, at_hour, on_weekday, since)), zone)
    for _ in range(25):
        if not quiet(quiet_from, quiet_to, zone, at):
            return at
        at = full_hour(at + timedelta(microseconds=1), zone)
    return None


def _micros(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _at(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


@dataclass
class Owner:
    """What is known of an owner: wishes by the newest row, the last digest, rows not come up yet, rows that wait, and when to wake; times in microseconds."""

    stated: int | None = None
    wishes: list | None = None
    last: int | None = None
    held: list = field(default_factory=list)
    waiting: list = field(default_factory=list)
    wake: int | None = None

    def how(self) -> tuple:
        mode, zone, *rest = self.wishes
        return (mode, ZoneInfo(zone), *rest)

    def take(self, r: Row) -> bool:
        """Hold a row; whether it goes out at once."""
        if self.stated is None or r.created >= self.stated:
            self.stated, self.wishes = r.created, [r.mode or "immediate", r.zone or ZONE, r.at_hour or 0, r.on_weekday or 1, r.quiet_from, r.quiet_to]
        how = self.how()
        sent = r.urgency == "critical" or how[0] == "immediate" and not quiet(how[4], how[5], how[1], _at(r.created))
        self.held.append([r.created, r.notification_id, r.urgency, sent])
        self.wake = r.created if self.wake is None else min(self.wake, r.created)
        return sent

    def advance(self, limit: int) -> list[tuple]:
        """Everything up to an instant, in order: rows come up, digests close. Gives ``closed, notification_id, urgency, created``."""
        held = sorted(self.held, key=lambda r: (r[0], r[1] or ""))
        coming, self.held = [r for r in held if r[0] <= limit], [r for r in held if r[0] > limit]
        how, out, known = self.how(), [], (None, None)
        oldest = min((r[0] for r in self.waiting), default=None)
        now = oldest or 0

        def due() -> int | None:
            nonlocal known
            if not self.waiting:
                return None
            since = oldest if self.last is None else self.last
            if known[0] != since:  # nothing else moves it: "now" never passes an instant that is due
                at = closing(how, _at(since), _at(max(now, oldest)))
                known = (since, None if at is None else _micros(at))
            return known[1]

        def close_until(until: int) -> None:
            nonlocal now, oldest
            at = due()
            if at is not None and at <= until:
                out.extend((at, r[1], r[2], r[0]) for r in self.waiting)
                self.waiting, self.last, now, oldest = [], at, at, None

        for created, name, urgency, sent in coming:
            close_until(created - 1)
            now = max(now, created)
            if sent:
                self.last = created if self.last is None else max(self.last, created)
            else:
                self.waiting.append([created, name, urgency])
                oldest = created if oldest is None else min(oldest, created)
        close_until(limit)
        self.wake = min((x for x in (due(), self.held[0][0] if self.held else None) if x is not None), default=None)
        return out


class Digests(StatefulProcessor):
    """State of a bucket: its owners, and the timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owners = handle.getValueState("owners", "owners string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        owners, first = self._stored(), None
        for r in rows:
            if r.owner_id not in owners:
                owners[r.owner_id] = Owner()
            if owners[r.owner_id].take(r):
                yield Row(owner_id=r.owner_id, closed_at=r.created, notification_id=r.notification_id, urgency=r.urgency, created_at=r.created)
            first = r.created if first is None else min(first, r.created)
        if first is not None:
            self._store(owners)
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Owners that wake up to the watermark."""
        limit = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        self.timer.clear()
        owners = self._stored()
        for owner_id, owner in owners.items():
            if owner.wake is not None and owner.wake <= limit:
                for closed, name, urgency, created in owner.advance(limit):
                    yield Row(owner_id=owner_id, closed_at=closed, notification_id=name, urgency=urgency, created_at=created)
        self._store(owners)
        following = [o.wake for o in owners.values() if o.wake is not None]
        if following:
            self._wake(min(following))

    def _stored(self) -> dict[str | None, Owner]:
        return {name: Owner(*fields) for name, *fields in json.loads(self.owners.get()[0])} if self.owners.exists() else {}

    def _store(self, owners: dict[str | None, Owner]) -> None:
        self.owners.update((json.dumps([[name, o.stated, o.wishes, o.last, o.held, o.waiting, o.wake] for name, o in owners.items()]),))

    def _wake(self, micros: int) -> None:
        """Set the timer, unless it is set for earlier."""
        millis = -(-micros // 1000)
        if self.timer.exists():
            if self.timer.get()[0] <= millis:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(millis)
        self.timer.update((millis,))

    def close(self) -> None:
        pass


def digest_stream(notifications: DataFrame, late: str = "15 minutes") -> DataFrame:
    """``owner_id, closed_at, notification_id, urgency, created_at``: what goes out and when.

    ``notifications(notification_id, owner_id, urgency, created_at)`` with the owner's preferences ``mode, zone, at_hour, on_weekday, quiet_from, quiet_to``
    beside them (nulls for owners without any). Rows that come later than ``late`` behind the newest are taken as they come. Needs the RocksDB state store (``alerts.use_rocksdb``).
    """
    named = notifications.withColumns({c: F.col(c).cast("string") for c in ("notification_id", "owner_id")}).withColumns({c: F.col(c).cast("int") for c in ("at_hour", "on_weekday", "quiet_from", "quiet_to")})
    rows = named.select("notification_id", "owner_id", "urgency", "created_at", F.unix_micros("created_at").alias("created"), "mode", "zone", "at_hour", "on_weekday", "quiet_from", "quiet_to")
    timed = rows.withColumn("bucket", F.pmod(F.xxhash64("owner_id"), F.lit(BUCKETS))).withWatermark("created_at", late)
    sent = timed.groupBy("bucket").transformWithState(statefulProcessor=Digests(), outputStructType=SENT, outputMode="Append", timeMode="EventTime")
    return sent.withColumns({c: F.timestamp_micros(c) for c in ("closed_at", "created_at")})
