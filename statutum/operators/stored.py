"""Tables that are kept: rows in folders by a hash of their key, of which a write replaces only those that it changes.

A table is a folder with ``data/v=<version>/bucket=<k>`` and a list of versions. The list of a version is one committed file that says, for each bucket,
in which version's folder it stands, so readers see a version whole or not at all. A write reads the buckets that its keys fall into, merges, and
writes again those whose rows differ, so the same write made twice leaves no new version. What neither of the last two versions names is
removed. One writer at a time; buckets bound what a change of one key rewrites.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_folder, materialize
from .legislative import stage_paces
from .writes import latest, merge_latest

_LISTED = "bucket int, version long, n long"


@dataclass
class Table:
    """A kept table: its folder, schema (DDL) and key columns; ``buckets`` is fixed when it is first written."""

    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _versions(self) -> list[tuple[int, dict[int, int]]]:
        """The last two versions, newest first, each with the version's folder of every bucket; at most ``buckets`` rows of each."""
        try:
            listed = self.spark.read.schema(_LISTED).parquet(f"{self.root}/versions")
            last = [r["n"] for r in listed.select("n").distinct().orderBy(F.desc("n")).limit(2).collect()]
            rows = listed.where(F.col("n").isin(*last)).collect() if last else []
        except AnalysisException as absent:
            if "PATH_NOT_FOUND" not in str(absent):
                raise
            return []
        return [(n, {r["bucket"]: r["version"] for r in rows if r["n"] == n and r["bucket"] >= 0}) for n in last]

    def version(self) -> int:
        """The number of the newest version, 0 if nothing was ever written."""
        found = self._versions()
        return found[0][0] if found else 0

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of some of its buckets."""
        found = self._versions()
        where = {k: v for k, v in found[0][1].items() if only is None or k in only} if found else {}
        paths = [f"{self.root}/data/v={v}/bucket={k}" for k, v in sorted(where.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merge rows into the table: ``merge(held, rows)`` gives the rows of the buckets concerned. Returns the buckets written."""
        rows = materialize(rows, "incoming")
        touched = sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())
        held = self.read(touched)
        columns = held.columns
        merged = materialize(merge(held, rows).select(*columns).withColumn("bucket", self.bucket()), "merged")
        digest = F.xxhash64(*columns)
        sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("x"), F.sum(F.shiftright(digest, 32)).alias("s")]
        before = {r["bucket"]: (r["n"], r["x"], r["s"]) for r in held.withColumn("bucket", self.bucket()).groupBy("bucket").agg(*sums).collect()}
        after = {r["bucket"]: (r["n"], r["x"], r["s"]) for r in merged.groupBy("bucket").agg(*sums).collect()}
        changed = sorted(k for k in touched if before.get(k) != after.get(k))
        if not changed:
            return []
        versions = self._versions()
        number, where = (versions[0][0] + 1, dict(versions[0][1])) if versions else (1, {})
        merged.where(F.col("bucket").isin(*changed)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/v={number}")
        for k in changed:
            if k in after:
                where[k] = number
            else:
                where.pop(k, None)
        listed = [(k, v) for k, v in sorted(where.items())] or [(-1, number)]  # a table may become empty
        self.spark.createDataFrame(listed, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/n={number}")
        if len(versions) > 1:  # of the version before the last two, what neither names
            old, kept = versions[1], {(k, v) for w in (where, versions[0][1]) for k, v in w.items()}
            for k, v in old[1].items():
                if (k, v) not in kept:
                    drop_folder(self.spark, f"{self.root}/data/v={v}/bucket={k}")
            drop_folder(self.spark, f"{self.root}/versions/n={old[0]}")
        return changed

    def upsert(self, rows: DataFrame, arrival: str, keep: tuple[str, ...] = ()) -> list[int]:
        """``writes.merge_latest`` of rows into the table: of rows with one key the last by ``arrival``, unless the stored one is later."""

        def merge(held: DataFrame, new: DataFrame) -> DataFrame:
            stored_at = held.select(*(F.col(k).alias(f"{k}_") for k in self.keys), F.col(arrival).alias("stored_at_"))
            same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in self.keys]
            newest = latest(new, list(self.keys), arrival)
            fresh = newest.join(stored_at, same, "left").where(F.col("stored_at_").isNull() | (F.col(arrival) >= F.col("stored_at_")))
            return merge_latest(held, fresh.select(*new.columns), list(self.keys), arrival, keep)

        return self.write(rows, merge)


LENGTHS = "initiator string, stage string, seconds long, k long"


def stay_lengths(spark: SparkSession, root: str, buckets: int = 16) -> Table:
    """A kept multiset of stays' lengths: how many stays of an initiator in a stage took so many seconds."""
    return Table(spark, root, LENGTHS, ("initiator", "stage", "seconds"), buckets)


def add_stays(lengths: Table, stated: DataFrame, withdrawn: DataFrame | None = None) -> list[int]:
    """Add the stays of a batch, ``(initiator, stage, seconds)`` each, and take out those that it restates.

    Counts are added to those held and equal lengths are one row, so what is read and written is the small table's buckets concerned, never earlier stays.
    """
    one = lambda rows, n: rows.groupBy("initiator", "stage", "seconds").agg((F.count(F.lit(1)) * n).alias("k"))
    change = one(stated, 1) if withdrawn is None else one(stated, 1).unionByName(one(withdrawn, -1))
    together = lambda rows: rows.groupBy("initiator", "stage", "seconds").agg(F.sum("k").alias("k")).where("k <> 0")
    return lengths.write(together(change), lambda held, new: together(held.unionByName(new.select(*held.columns))))


def kept_paces(lengths: Table) -> DataFrame:
    """As ``legislative.stage_paces`` of all stays added so far, from their kept counts."""
    return stage_paces(lengths.read(), "k")
