"""A training corpus from ``documents``: toxic texts go, near copies go, benchmark passages go, sources are mixed, token ids are written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Stages
judge what the stage before kept. Null and empty texts pass every stage; equal rows are treated alike. Columns that stages do not
read are carried in a struct, so their names may be any, those of the operators' results included, and their values stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutum.llm import decontamination, mixing, near_dedup, token_tables, toxicity
from statutum.llm.common import components, materialize, packed, table, unpacked
from statutum.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    kept = toxicity.toxicity(packed(docs, "doc_id", "text"), table(spark, sf_dir, "labels")).where("predicted = 0")
    return unpacked(kept, docs.columns, "doc_id", "text")


#: Shingle, numerator and denominator of each measure of near copies: one finds scattered edits, the other single long ones.
NEAR_COPIES = ((3, 85, 100), (5, 80, 100))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of equal ids in it, all do.

    Documents are near copies if any measure of ``NEAR_COPIES`` links them; groups are connected by the links of all.
    """
    found = [near_dedup.near_duplicates(docs, *measure).where("doc_id is not null").select("doc_id", "component_id") for measure in NEAR_COPIES]
    groups = components(reduce(DataFrame.unionByName, found).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    later = groups.where("node <> component").select(F.col("node").alias("doc_id"))
    kept = found[0].select("doc_id").distinct().join(later, "doc_id", "left_anti")
    rows = packed(docs, "doc_id")
    return unpacked(rows.where("doc_id is null").unionByName(rows.join(kept, "doc_id", "left_semi")), docs.columns, "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more are benchmark passages go."""
    kept = decontamination.contamination(packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark")).where("not contamination.contaminated")
    return unpacked(kept, docs.columns, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; documents taken no time go. Equal rows get the same copies."""
    rows = packed(docs, "doc_id", "text", "source")
    taken = mixing.mix(rows).where("copies > 0").groupBy("doc_id", "source", "text_hash").agg(F.max("copies").alias("copies"))
    taken = materialize(taken, "copies").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("text_hash").alias("h"), "copies")
    keyed = rows.withColumn("h_", F.xxhash64("text"))
    joined = keyed.join(taken, keyed["doc_id"].eqNullSafe(F.col("i")) & keyed["source"].eqNullSafe(F.col("s")) & (keyed["h_"] == F.col("h")))
    return unpacked(joined.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns, "doc_id", "text", "source")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as sorted-string tables in the shared folder, read back: one row for each entry."""
    return token_tables.token_round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_tables", write_tokens),
]

#: Neither the classifier nor the tokenizer can be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
