"""Search over acts and drafts: index, ranking, filters, facets, highlights."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import highlight, stems
from ..storage import materialize

#: Of the ranking: saturation, length, weight of a title; values of a facet; entries of a page, and at most.
K1, B, TITLE_BOOST, FACET_VALUES, PAGE, MOST = 1.2, 0.75, 8.0, 20, 20, 100
FACETS = ("kind", "stage", "initiator", "act_type")
#: Entry numbers of a block, as a power of two; blocks that a search looks at first; blocks that are named to the scan one by one, at most.
BLOCK_BITS, FIRST_BLOCKS, NAMED_BLOCKS = 12, 16, 1000


@dataclass
class Index:
    """Stored tables of an index: entries with stems, number and block, postings of their titles in blocks, one row of statistics, identifiers.

    A row of ``postings`` is a block of one stem, or a part of it: ``stem, block, n, top`` (entries in it, and the most that the stem adds to any one's score, but for
    the stem's own weight) and the entries as arrays ``ids, numbers, tfs, lengths``.
    """

    entries: DataFrame
    postings: DataFrame
    statistics: DataFrame
    names: DataFrame | None = None


class Found(dict):
    """Parts of an answer, each worked out when it is first asked for."""

    def __init__(self, **parts: Callable[[], DataFrame]):
        super().__init__()
        self._parts = parts

    def __missing__(self, name: str) -> DataFrame:
        self[name] = part = self._parts[name]()
        return part


def index_entries(acts: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row for each act and draft: ``id`` is ``kind:own id``, columns that a kind lacks are null."""
    a = acts.where("eli is not null").select(
        F.concat(F.lit("act:"), "act_id").alias("id"), F.lit("act").alias("kind"), "title", "eli", "act_type", "publisher", F.array("eli").alias("identifiers"), "announced_on", "in_force_from"
    )
    d = drafts.select(F.concat(F.lit("draft:"), "draft_id").alias("id"), F.lit("draft").alias("kind"), "title", "initiator", "term", "stage", "outcome", "identifiers", "started_on")
    return a.unionByName(d, allowMissingColumns=True).withColumn("stems", stems(F.col("title")))


def own_id(index_id: Column) -> Column:
    """The part of an entry's id after the first colon."""
    return F.substring(index_id, F.instr(index_id, ":") + 1, F.length(index_id))


def postings(entries: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``stem, id, tf, length`` of every entry; stored by stem this is the index that searches read.

    With ``wanted(stem)`` only those stems count, and others are dropped before anything is grouped.
    """
    # The outer form and a filter after it: for the inner one the optimizer would take titles apart once more to find empty ones.
    tokens = entries.select("id", F.size("stems").alias("length"), F.explode_outer("stems").alias("stem")).where("stem is not null")
    if wanted is not None:
        tokens = tokens.join(wanted, "stem", "left_semi")
    return tokens.groupBy("stem", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def statistics(entries: DataFrame) -> DataFrame:
    """One row: number of entries with words and their mean length."""
    with_words = F.when(F.size("stems") > 0, F.size("stems"))
    return entries.agg(F.count(with_words).alias("entries"), F.avg(with_words).alias("mean_length"))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    """What a stem adds to a title's score, but for the stem's own weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def numbered(entries: DataFrame) -> DataFrame:
    """Entries with ``number`` and ``block``, to be stored before they are read again."""
    return entries.withColumn("number", F.monotonically_increasing_id()).withColumn("block", F.shiftright("number", BLOCK_BITS))


_POSTINGS = "stem string, block long, ids array<string>, numbers array<long>, tfs array<int>, lengths array<int>"


def _posted(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of each batch of ``number, id, stems`` by stem and block: tokens are counted where they are read and never leave as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("number")))
            stems_of, number = batch.column("stems"), batch.column("number").to_numpy(zero_copy_only=False)
            length = pc.fill_null(pc.list_value_length(stems_of), 0).to_numpy(zero_copy_only=False)
            tokens = stems_of.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(length)), length)
            code = tokens.indices.to_numpy(zero_copy_only=False) if not tokens.indices.null_count else pc.fill_null(tokens.indices, -1).to_numpy(zero_copy_only=False)
            held, tf = np.unique((code.astype(np.int64) * max(1, len(length)) + row)[code >= 0], return_counts=True)
            if not len(held):
                continue
            code, row = held // len(length), held % len(length)
            block = number[row] >> bits
            start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
            of_entry = lambda values: pa.ListArray.from_arrays(pa.array(np.r_[start, len(held)], pa.int32()), values)
            columns = [tokens.dictionary.take(pa.array(code[start])), pa.array(block[start]), of_entry(batch.column("id").take(pa.array(row))), of_entry(pa.array(number[row])), of_entry(pa.array(tf, pa.int32())), of_entry(pa.array(length[row], pa.int32()))]
            for at in range(0, len(start), 50_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], names=["stem", "block", "ids", "numbers", "tfs", "lengths"])

    return run


def posting_blocks(entries: DataFrame, total: DataFrame) -> DataFrame:
    """Rows of ``Index.postings`` for numbered entries and their statistics; a block holds ``2 ** BLOCK_BITS`` entries at most.

    Entries that are not read together may make several rows of a stem and block.
    """
    plain = entries.where("stems is not null").select("number", F.col("id").cast("string").alias("id"), "stems")
    held = plain.mapInArrow(_posted(BLOCK_BITS), _POSTINGS).join(F.broadcast(total.select("mean_length")))  # one row
    adds = F.transform(F.arrays_zip("tfs", "lengths"), lambda r: saturation(r["tfs"], r["lengths"], F.col("mean_length")))
    return held.select("stem", "block", F.size("ids").cast("long").alias("n"), F.array_max(adds).alias("top"), "ids", "numbers", "tfs", "lengths")


def _unblocked(blocks: DataFrame) -> DataFrame:
    """``stem, id, number, tf, length`` out of blocks."""
    rows = blocks.select("stem", F.explode(F.arrays_zip("ids", "numbers", "tfs", "lengths")).alias("r"))
    return rows.select("stem", F.col("r.ids").alias("id"), F.col("r.numbers").alias("number"), F.col("r.tfs").alias("tf"), F.col("r.lengths").alias("length"))


def title_scores(entries: DataFrame, queries: DataFrame, index: Index | DataFrame | None = None) -> DataFrame:
    """BM25 of titles: ``query, id, score, matched`` for ``queries(query, wanted array<string>)`` (a stem counts as often as it is asked).

    Only postings of stems that are asked for are kept before anything is shuffled for them, and partial sums are made by entry.
    With ``index`` titles are not taken apart again (with postings alone, to count their lengths only). Without it they are
    once for the postings and once for the lengths.
    """
    asked = queries.select("query", F.explode("wanted").alias("stem")).groupBy("query", "stem").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("stem").distinct()
    if index is None:
        found, total = postings(entries, wanted), statistics(entries)
    else:
        given = Index(entries, index, statistics(entries)) if isinstance(index, DataFrame) else index
        found, total = _unblocked(given.postings.join(wanted, "stem", "left_semi")), given.statistics
    df = found.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    weighted = found.join(df, "stem").join(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("entries") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = weighted.select("stem", "id", (idf * saturation(F.col("tf"), F.col("length"), F.col("mean_length"))).alias("w"))
    return asked.join(weighted, "stem").groupBy("query", "id").agg(F.sum(F.col("w") * F.col("times")).alias("score"), F.count(F.lit(1)).alias("matched"))


def keep(entries: DataFrame, kinds=(), stages=(), initiators=(), act_types=()) -> DataFrame:
    """Entries that pass the filters; an empty filter restricts nothing."""
    given = {"kind": kinds, "stage": stages, "initiator": initiators, "act_type": act_types}
    return entries.where(reduce(lambda a, b: a & b, [F.col(c).isin(*v) for c, v in given.items() if v], F.lit(True)))


def search(entries: DataFrame, text: str | None, offset: int = 0, size: int = PAGE, index: Index | DataFrame | None = None, **filters) -> Found:
    """``hits`` (a page, best first), ``total`` and ``facets`` of one search, each worked out when it is asked for.

    An entry matches by a stem of its title (weighing ``TITLE_BOOST``) or by one of its identifiers as a whole. Blank text lists
    all that pass the filters, in order of ids. Filters change no score. ``index``: a stored index of the entries, if there is any; then the page reads
    only blocks of postings that can reach it (see ``Ranked``). Total and facets are counted from one table of what matches,
    which is stored once for both and has a row for each combination of fields.
    """
    text = (text or "").strip()
    offset, size = max(0, offset), min(max(1, size), MOST)
    if text and isinstance(index, Index) and index.names is not None:
        ranked = Ranked(index, text, filters)
        matching, page = ranked.matching, lambda: ranked.page(offset, size)
    else:
        rows = keep(entries, **filters)
        if text:
            query = entries.sparkSession.range(1).select(F.lit(0).alias("query"), stems(F.lit(text)).alias("wanted"))
            scores = title_scores(entries, query, index).select("id", (TITLE_BOOST * F.col("score")).alias("title_score"))
            rows = rows.join(scores, "id", "left").withColumn("named", F.array_contains(F.coalesce("identifiers", F.array().cast("array<string>")), text))
            rows = rows.where(F.col("title_score").isNotNull() | F.col("named"))
            rows = rows.withColumn("score", F.coalesce("title_score", F.lit(0.0)) + F.when(F.col("named"), 1.0).otherwise(0.0))
        else:
            rows = rows.withColumn("score", F.lit(0.0))
        matching, page = lambda: rows, lambda: rows.orderBy(F.col("score").desc(), "id").offset(offset).limit(size)
    stored: list[DataFrame] = []

    def together() -> DataFrame:
        if not stored:
            stored.append(materialize(combinations(matching(), FACETS), "matches"))
        return stored[0]

    return Found(
        hits=lambda: page().select("id", "kind", "title", "eli", "score", highlight(F.col("title"), stems(F.lit(text))).alias("highlight")),
        total=lambda: together().agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total")),
        facets=lambda: most_frequent(together(), FACETS, FACET_VALUES),
    )


class Ranked:
    """A search of a stored index by the bounds of its blocks.

    The most that an entry of a block can score is the sum over the query's stems of the stem's weight and the block's ``top``, and 1 where
    an entry of it is named. Blocks of the highest bounds are scored first, as many as hold a page that passes the filters; the last score of
    that page is the bar, and only blocks whose bound reaches it are read for the answer, so the page is that of scoring everything. What comes to the driver
    are the query's stems with their numbers of entries, the bar, and the names of at most ``NAMED_BLOCKS`` blocks.
    """

    def __init__(self, index: Index, text: str, filters: dict):
        self.index, self.text, self.filters = index, text, filters
        spark = index.entries.sparkSession
        times = Counter(spark.range(1).select(stems(F.lit(text)).alias("w")).first()["w"])
        self.blocks = index.postings.where(F.col("stem").isin(*times))
        total = index.statistics.first()
        self.mean = total["mean_length"] or 1.0
        df = {r["stem"]: r["df"] for r in self.blocks.groupBy("stem").agg(F.sum("n").alias("df")).collect()}
        weights = {w: TITLE_BOOST * times[w] * log(1 + (total["entries"] - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.weight = F.create_map(*(F.lit(x) for w in sorted(weights) for x in (w, weights[w]))) if weights else F.create_map().cast("map<string,double>")
        self.named = index.names.where(F.col("identifier") == text).select("id", "number").distinct()

    def bounds(self) -> DataFrame:
        """``block, bound`` of every block in which something matches."""
        tops = self.blocks.groupBy("stem", "block").agg(F.max("top").alias("top"))
        by_title = tops.select("block", (F.element_at(self.weight, F.col("stem")) * F.col("top")).alias("bound"))
        by_name = self.named.select(F.shiftright("number", BLOCK_BITS).alias("block"), F.lit(1.0).alias("bound")).distinct()
        return by_title.unionByName(by_name).groupBy("block").agg(F.sum("bound").alias("bound"))

    def scored(self, chosen: list[int] | DataFrame) -> DataFrame:
        """Matching entries of the chosen blocks that pass the filters, with their columns and ``score``."""
        within = (lambda t: t.where(F.col("block").isin(*chosen))) if isinstance(chosen, list) else (lambda t: t.join(chosen, "block", "left_semi"))
        rows = _unblocked(within(self.blocks))
        adds = rows.select("id", "number", (F.element_at(self.weight, F.col("stem")) * saturation(F.col("tf"), F.col("length"), F.lit(self.mean))).alias("w"))
        adds = adds.unionByName(within(self.named.withColumn("block", F.shiftright("number", BLOCK_BITS))).select("id", "number", F.lit(1.0).alias("w")))
        scores = adds.groupBy("number").agg(F.sum("w").alias("score"))
        return keep(within(self.index.entries), **self.filters).join(scores, "number")

    def chosen(self, least: int) -> list[int] | DataFrame:
        """Blocks that can reach the best ``least`` entries."""
        bounds = materialize(self.bounds(), "bounds")
        first = FIRST_BLOCKS
        while True:
            best = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]
            page = self.scored(best).select("score").orderBy(F.desc("score")).limit(least).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).first()
            if page["n"] == least:
                reach = bounds.where(F.col("bound") >= page["bar"] - 1e-9)
                break
            if len(best) < first or first >= NAMED_BLOCKS:
                reach = bounds
                break
            first = min(8 * first, NAMED_BLOCKS)
        few = [r["block"] for r in reach.select("block").limit(NAMED_BLOCKS + 1).collect()]
        return few if len(few) <= NAMED_BLOCKS else reach.select("block")

    def page(self, offset: int, size: int) -> DataFrame:
        return self.scored(self.chosen(offset + size)).orderBy(F.col("score").desc(), "id").offset(offset).limit(size)

    def matching(self) -> DataFrame:
        """All that matches and passes the filters; no score is worked out."""
        numbers = self.blocks.select(F.explode("numbers").alias("number")).unionByName(self.named.select("number")).distinct()
        return keep(self.index.entries, **self.filters).join(numbers, "number", "left_semi")


def combinations(entries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``k`` entries for each combination of the fields."""
    return entries.groupBy(*fields).agg(F.count(F.lit(1)).alias("k"))


def most_frequent(together: DataFrame, fields: tuple[str, ...], values: int) -> DataFrame:
    """``field, value, n`` out of combinations: the most frequent values of each field, ties by value; nulls do not count."""
    long = together.unpivot(["k"], list(fields), "field", "value").where("value is not null").groupBy("field", "value").agg(F.sum("k").alias("n"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value"))
    return long.withColumn("place_", place).where(F.col("place_") <= values).drop("place_")


def facets(entries: DataFrame, fields: tuple[str, ...] = FACETS, values: int = FACET_VALUES) -> DataFrame:
    """The most frequent values of each field.

    Rows are counted by all fields together before they are unpivoted: the shuffle carries combinations, not entries.
    """
    return most_frequent(combinations(entries, fields), fields, values)


def titles_matching(entries: DataFrame, words: DataFrame, limit: int = 10, index: Index | None = None) -> DataFrame:
    """Entries whose titles hold all stems of ``words(value, wanted)``, the best ``limit`` of each: ``value, entry_kind, id, eli, title``."""
    queries = words.where(F.size("wanted") > 0).select(F.col("value").alias("query"), F.array_distinct("wanted").alias("wanted"))
    scores = title_scores(entries, queries, index).join(queries.select("query", F.size("wanted").alias("all_")), "query").where("matched = all_")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    best = scores.withColumn("place_", place).where(F.col("place_") <= limit)
    return best.join(entries.select("id", F.col("kind").alias("entry_kind"), "eli", "title"), "id").select(F.col("query").alias("value"), "entry_kind", "id", "eli", "title")
