"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

Targets: the sources, ordered by code point with null last, weigh 3, 1, 2, repeating. They share ``SHARE`` times all words;
a source's target stops at ``MOST`` times its own words and what is over is shared again by weight. Whole copies: every
document is taken as often as its source's target holds all of the source. The rest of the target is filled by a Pareto
sample: a document's inclusion probability grows with the ``POWER``-th power of its size and is scaled so that the expected
words meet the rest; documents whose probability would reach 1 are taken for certain, and the others' are scaled to what is left (sizes are
grouped, so a source's window holds its distinct sizes); documents are ranked by ``odds(u) / odds(p)``, u being a hash of the id and the seed, and are taken in
that order until the rest is reached, so that the sample's size in words is fixed up to one document.

The order statistics are found without sorting a source: words are summed by source and bin of the rank, the running sums
of the bins tell the bin in which the rest is reached, and only that bin's rows are ordered. A source may hold any share
of the rows. A null or empty text has size 0 and is never sampled. Equal ids share u (a null id takes its text's hash instead), ties go by size, then by a hash of the text;
equal rows are told apart by nothing but take the same room. Sources without words have target 0. Sources are ranked and shared out to in
one task, one row for each: tens of thousands are no burden, a source for each host of a large crawl would be. A very long text counts by its words, which its own
task counts; no text travels. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Of sizes in inclusion probabilities; of chance; rows in a bin, about.
POWER, SEED, BIN_ROWS = 0.5, 20240229, 200


def size_of(text: Column) -> Column:
    r"""Number of runs of characters other than U+0020 and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, n, tempered_words, target`` for ``sizes(source, size)``: one row for each source.

    The windows below go over sources, which are grouped before. A source is capped if its room for each weight is small:
    with sources in that order, the level at which all share equally is known after each, and the first level that
    the next source can take holds for all that follow.
    """
    tempered = F.pow(F.col("size").cast("double"), F.lit(POWER))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.sum(tempered * F.col("size")).alias("tempered_words"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int"))
    cap = F.lit(MOST) * F.col("source_size")
    by = by.withColumn("w", weight).withColumn("cap", cap).withColumn("room", F.col("cap") / F.col("w"))
    order = Window.orderBy("room", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.withColumn("total", F.lit(SHARE) * F.sum("source_size").over(everything)).withColumn("weights", F.sum("w").over(everything))
    left_words = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.col("weights") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("level", left_words / left_weight)
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(everything)["level"]
    return by.withColumn("open_level", level).select("source", "source_size", "n", "tempered_words", F.least("cap", F.coalesce(F.col("open_level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` without text, with ``size, source_size, target, copies`` and ``taken`` (copies times size)."""
    sizes = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    return copies_of(sizes)


def without_certain(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with ``open_size``: larger documents are taken for certain, and ``rest`` and ``tempered_words`` are what is left without them.

    In order of size, largest first, a size is certain if its probability, scaled to what is left without the larger ones, reaches 1; the
    first that does not ends the row of certain ones.
    """
    by_size = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("k"))
    by_size = by_size.join(goal.where("rest > 0").select("s", "rest", "tempered_words"), by_size["source"].eqNullSafe(F.col("s")))
    tempered = F.pow(F.col("size").cast("double"), F.lit(POWER))
    larger = Window.partitionBy("s").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    words, weight = (F.coalesce(F.sum(x).over(larger), F.lit(0.0)) for x in (F.col("k") * F.col("size").cast("double"), F.col("k") * tempered * F.col("size")))
    left = by_size.withColumn("left_words", F.col("rest") - words).withColumn("left_weight", F.col("tempered_words") - weight)
    open_ = left.where(F.col("left_words") * tempered < F.col("left_weight") * (1 - 1e-9)).groupBy("s").agg(F.max(F.struct("size", "left_words", "left_weight")).alias("o"))
    joined = goal.join(open_.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
    return joined.select("s", "source_size", "target", "whole", F.coalesce("o.left_words", "rest").alias("rest"), F.coalesce("o.left_weight", "tempered_words").alias("tempered_words"), "n", F.coalesce("o.size", F.lit(1 << 62)).alias("open_size"))


def copies_of(sizes: DataFrame) -> DataFrame:
    """Copies for each row of ``sizes(doc_id, source, size, text_hash)``; the table is read four times and should be stored."""
    goal = targets(sizes.select("source", "size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    goal = materialize(goal.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", "tempered_words", "n"), "goals")
    goal = materialize(without_certain(sizes, goal), "open_goals")
    rows = sizes.join(goal, sizes["source"].eqNullSafe(F.col("s"))).drop("s")
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(SEED), "text_hash")).otherwise(F.xxhash64(F.lit(SEED), "doc_id"))
    u = (F.pmod(hashed, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("rest") * F.pow(F.col("size").cast("double"), F.lit(POWER)) / F.nullif("tempered_words", F.lit(0.0))))
    rank = F.log(u / (1 - u)) - F.log(p / (1 - p))
    certain = (F.col("rest") > 0) & (F.col("size") > F.col("open_size"))
    rows = rows.withColumn("whole", F.col("whole") + F.when(certain, 1).otherwise(0)).withColumn("rank", F.when((F.col("size") > 0) & (F.col("rest") > 0) & ~certain, rank))
    bins = F.greatest(F.lit(64), F.ceil(F.col("n") / F.lit(BIN_ROWS)))
    share = F.least(F.lit(0.98), F.greatest(F.lit(1e-9), F.try_divide("rest", "source_size")))
    middle = F.col("rank") + F.log(share / (1 - share))  # about the log odds of u: the logistic spreads it evenly
    rows = rows.withColumn("bin", F.floor(bins / (1 + F.exp(-middle))).cast("long"))
    by_bin = rows.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossed = by_bin.withColumn("upto", F.sum("words").over(run)).where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
    crossed = materialize(crossed.select(F.col("source").alias("s"), F.col("at.bin").alias("last_bin"), F.col("at.before").alias("before")), "crossed")
    rows = rows.join(crossed, rows["source"].eqNullSafe(F.col("s")), "left").drop("s")
    inside = (F.col("rank").isNotNull()) & (F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin")))
    columns = ["doc_id", "source", "text_hash", "size", "source_size", "target"]
    settled = rows.where(F.col("rank").isNull() | F.col("last_bin").isNull() | (F.col("bin") != F.col("last_bin"))).select(*columns, (F.col("whole") + F.when(inside, 1).otherwise(0)).alias("copies"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = rows.where("rank is not null and bin = last_bin").withColumn("filled", F.col("before") + F.sum("size").over(order))
    near = F.abs(F.col("filled") - F.col("rest")) <= F.abs(F.col("filled") - F.col("size") - F.col("rest"))
    taken = (F.col("filled") <= F.col("rest")) | ((F.col("filled") - F.col("size") < F.col("rest")) & near)
    open_ = open_.select(*columns, (F.col("whole") + F.when(taken, 1).otherwise(0)).alias("copies"))
    return settled.unionByName(open_).withColumn("taken", F.col("copies") * F.col("size"))
