"""What a fetch of a source comes to, as columns: outcomes, rates, tries. Fetching itself is no work for Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vocabulary import first_that_holds

#: Tries of a request; seconds before the second.
TRIES, FIRST_WAIT_S = 4, 1.0


def fetch_outcome(status: Column, allowed: Column, reserved: Column) -> Column:
    """``refused`` where robots forbid the request or the answer reserves text and data mining, else by status; no status is a failure."""
    answered = status.between(200, 299)
    refused = ~F.coalesce(allowed, F.lit(True)) | (answered & F.coalesce(reserved, F.lit(False)))
    return first_that_holds([(refused, "refused"), (status == 304, "not_modified"), (answered, "fetched")], "failed")


def may_retry(status: Column, tries: Column) -> Column:
    """Too many requests and errors of the server are tried again, up to a number of tries."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False)) & (tries < TRIES)


def requests_per_second(declared: Column, policy: Column) -> Column:
    """The slower of what a source asks for and what the policy allows; a missing one does not count."""
    return F.least(declared, policy)


def wait_before_retry(tries: Column) -> Column:
    """Seconds before the next try, without the random part: doubles with each."""
    return F.lit(FIRST_WAIT_S) * F.pow(F.lit(2.0), tries - 1)


def jittered_wait(tries: Column, request: Column, share: float = 0.5) -> Column:
    """Seconds before the next try, with a part of up to ``share`` of them added by chance: a hash of the request and the try, so that a replay waits as long."""
    chance = F.pmod(F.xxhash64(request, tries), F.lit(1 << 20)) / float(1 << 20)
    return wait_before_retry(tries) * (1 + share * chance)


def paced(requests: DataFrame) -> DataFrame:
    """``requests(host, request, asked_at, per_second)`` with ``sent_at``: a host's requests in order of asking, none before it is asked for or too soon after the one before.

    The k-th is sent at the largest ``asked_at + gap * (k - j)`` of the requests j up to it, which is a running maximum. The times of a host hang together, so
    its requests are put in order in one task; rows without a host are sent as they are asked for.
    """
    gap = F.round(F.lit(1e6) / F.col("per_second")).cast("long")
    order = Window.partitionBy("host").orderBy("asked_at", "request")
    named = requests.where("host is not null").withColumn("gap_", gap).withColumn("place_", F.row_number().over(order))
    ahead = F.max(F.unix_micros("asked_at") - F.col("place_") * F.col("gap_")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sent = named.withColumn("sent_at", F.timestamp_micros(ahead + F.col("place_") * F.col("gap_"))).drop("gap_", "place_")
    return sent.unionByName(requests.where("host is null").withColumn("sent_at", F.col("asked_at")))
