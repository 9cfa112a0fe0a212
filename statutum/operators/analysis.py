"""An analyser of words learned from pairs of form and lemma: edit commands by suffix, the longest known suffix deciding.

A command takes letters off the end of a word and puts others there. Every suffix of a form that covers what its command takes off votes for
it, and the most frequent command of a suffix is its rule. Rules that say what their longest shorter suffix says are dropped, as a trie of suffixes needs
no node that repeats its parent. Learning is group-bys and joins over distinct suffixes. Up to ``HELD`` rules go to the tasks, which stem each distinct word
of an Arrow batch once, so texts are not shuffled; with more rules, words are stemmed by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import STOP_WORDS
from ..functions.word_forms import word_forms

#: Letters of a suffix, and letters that a command must leave.
LONGEST, LEFT = 8, 2
#: Rules that a task may hold; words that it remembers.
HELD, REMEMBERED = 100_000, 300_000


def segments(text: Column, language: str = "pl", country: str = "PL") -> Column:
    """Lower-case words of a text by Unicode's word boundaries, in the rules of a language: ``array<string>``.

    Marks inside a word (an apostrophe, a point between digits) stay; words without a letter or digit are none.
    """
    return F.filter(F.flatten(F.sentences(F.lower(F.coalesce(text, F.lit(""))), F.lit(language), F.lit(country))), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def known_forms(spark: SparkSession) -> DataFrame:
    """``form, lemma`` of the library's own list."""
    return spark.createDataFrame(list(word_forms()), "form string, lemma string")


def _suffixes(word: Column, least: Column) -> Column:
    """Lengths of a word's suffixes, from a least one to ``LONGEST``; none where the word is shorter."""
    most = F.least(F.lit(LONGEST), F.length(word))
    return F.when(most >= least, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))


def edit_commands(pairs: DataFrame) -> DataFrame:
    """``suffix, cut, put``: the rules learned from ``pairs(form, lemma)``; pairs with nulls or empty words teach nothing.

    Of commands of a suffix that are as frequent, the one that takes off less is the rule, then the first by what it puts.
    """
    given = pairs.where("form <> '' and lemma <> ''").select("form", "lemma").distinct()
    shared = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length("form"), F.length("lemma"))), lambda i: F.left("form", i) == F.left("lemma", i)))
    said = given.withColumn("shared", shared).select("form", (F.length("form") - F.col("shared")).alias("cut"), F.substring("lemma", F.col("shared") + 1, F.length("lemma")).alias("put"))
    votes = said.select("cut", "put", "form", F.explode(_suffixes(F.col("form"), F.greatest(F.lit(1), F.col("cut")))).alias("n"))
    counted = votes.groupBy(F.right("form", F.col("n")).alias("suffix"), "cut", "put").agg(F.count(F.lit(1)).alias("votes"))
    best = counted.groupBy("suffix").agg(F.min(F.struct(-F.col("votes"), "cut", "put")).alias("b")).select("suffix", "b.cut", "b.put")
    shorter = best.select("suffix", "cut", "put", F.explode(F.sequence(F.lit(0), F.length("suffix") - 1)).alias("n")).select("suffix", "cut", "put", F.right("suffix", F.col("n")).alias("parent"))
    parents = best.select(F.col("suffix").alias("parent"), F.struct("cut", "put").alias("said"))
    nearest = shorter.join(parents, "parent").groupBy("suffix", "cut", "put").agg(F.max_by("said", F.length("parent")).alias("said"))
    same = nearest.where((F.col("said.cut") == F.col("cut")) & (F.col("said.put") == F.col("put")))
    return best.join(same.select("suffix"), "suffix", "left_anti")


def lemmas(words: DataFrame, rules: DataFrame) -> DataFrame:
    """``word, stem`` of each distinct ``word``; where no rule leaves ``LEFT`` letters, the word itself."""
    distinct = words.select("word").where("word is not null").distinct()
    ends = distinct.select("word", F.explode(_suffixes(F.col("word"), F.lit(1))).alias("n")).select("word", F.right("word", F.col("n")).alias("suffix"))
    said = ends.join(rules, "suffix").where(F.length("word") - F.col("cut") >= LEFT)
    said = said.groupBy("word").agg(F.max_by(F.struct("cut", "put"), F.length("suffix")).alias("said"))
    stem = F.concat(F.left("word", F.length("word") - F.col("said.cut")), F.col("said.put"))
    return distinct.join(said, "word", "left").select("word", F.coalesce(stem, F.col("word")).alias("stem"))


def _stem_in_place(rules: dict[str, tuple[int, str]]):
    def stem(word: str) -> str:
        for n in range(min(LONGEST, len(word)), 0, -1):
            said = rules.get(word[-n:])
            if said and len(word) - said[0] >= LEFT:
                return word[: len(word) - said[0]] + said[1]
        return word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            words = batch.column(1)
            coded = words.flatten().dictionary_encode()  # the words of lists that are not null
            stems = []
            for word in coded.dictionary.to_pylist():
                found = known.get(word) or stem(word)
                if len(known) < REMEMBERED:
                    known[word] = found
                stems.append(found)
            sizes = pc.fill_null(pc.list_value_length(words), 0)
            ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
            stemmed = pa.array(stems, pa.string()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, stemmed)], names=["key", "stems"])

    return run


def analysed(texts: DataFrame, rules: DataFrame, words: Column | None = None, key: str = "id") -> DataFrame:
    """``key, stems``: stems of every text in its order, words without meaning left out; ``words`` (of ``title``, by ``segments``) may be given."""
    split = segments(F.col("title")) if words is None else words
    held = rules.select("suffix", "cut", "put").limit(HELD + 1).collect()
    if len(held) > HELD:
        return analysed_by_joins(texts, rules, split, key)
    kept = F.filter(split, lambda w: ~w.isin(*STOP_WORDS))
    kind = StructType([StructField("key", texts.schema[key].dataType), StructField("stems", ArrayType(StringType()))])
    done = texts.select(F.col(key).alias("key"), kept.alias("words")).mapInArrow(_stem_in_place({r.suffix: (r.cut, r.put) for r in held}), kind)
    return done.select(F.col("key").alias(key), "stems")


def analysed_by_joins(texts: DataFrame, rules: DataFrame, words: Column, key: str = "id") -> DataFrame:
    """The same for rules of any number: every distinct word is looked up once; the words of a text come together again by its key, which is unique."""
    found = texts.select(key, F.posexplode(words).alias("at", "word")).where(~F.col("word").isin(*STOP_WORDS))
    stemmed = found.join(lemmas(found, rules), "word")
    held = stemmed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "stem"))).alias("s")).select(key, F.col("s.stem").alias("stems"))
    return texts.select(key).join(held, key, "left").select(key, F.coalesce("stems", F.array().cast("array<string>")).alias("stems"))


def held_out(pairs: DataFrame, parts: int = 5) -> DataFrame:
    """``form, lemma, stem, lemma_stem``: each lemma's forms by rules learned from the other lemmas' parts, dealt by a hash of the lemma."""
    part = F.pmod(F.xxhash64("lemma"), F.lit(parts))
    out = None
    for k in range(parts):
        rules = edit_commands(pairs.where(part != k))
        asked = pairs.where(part == k).select("form", "lemma")
        of = lemmas(asked.select(F.col("form").alias("word")).unionByName(asked.select(F.col("lemma").alias("word"))), rules)
        done = asked.join(of.withColumnRenamed("word", "form"), "form").join(of.select(F.col("word").alias("lemma"), F.col("stem").alias("lemma_stem")), "lemma")
        out = done if out is None else out.unionByName(done)
    return out


def error_rate(judged: DataFrame) -> DataFrame:
    """One row: ``forms``, share of forms whose lemma is not found, and share of forms that don't meet their lemma in one stem."""
    wrong = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return judged.agg(F.count(F.lit(1)).alias("forms"), wrong(F.col("stem") != F.col("lemma")).alias("lemma_errors"), wrong(F.col("stem") != F.col("lemma_stem")).alias("parted"))
