"""Keys that larger tables have, and steps whose size is to follow the input's."""

import json

from pyspark.sql import functions as F

from statutum.functions import ids, vocabulary
from statutum.operators import legislative, validation
from statutum.sources import gazette


def test_positions_of_seven_digits_are_addresses(spark):
    payload = json.dumps({"ELI": "DU/2024/1200001", "title": "Ustawa", "references": {"Inne": [{"id": "DU/2020/1000000"}, {"id": "DU/2020/1/x"}]}})
    rows = spark.createDataFrame([("DU/2024/1200001", payload)], "external_id string, payload string")
    acts = gazette.parsed_acts(rows)
    assert [r.target for r in gazette.references(acts).collect()] == ["DU/2020/1000000"]
    assert [r.publisher for r in legislative.acts_of(acts).collect()] == ["DU"]
    kind, publisher = rows.select(vocabulary.gazette_kind(F.col("external_id")), ids.publisher_of(F.col("external_id"))).first()
    assert (kind, publisher) == ("act", "DU")
    refs = spark.createDataFrame([(1, "DU/2024/5", "DU/2024/1000000", "amends"), (2, "DU/2024/5", "DU/2024/", "amends")], "k int, from_eli string, to_eli string, relation string")
    assert [(r.rule, r.key) for r in validation.violations(refs, "act_reference", "k").collect()] == [("to", "2")]


def test_an_index_is_built_without_a_shuffle_of_tokens(spark):
    from statutum.operators import search

    rows = [(f"e{i}", ["a", "b", "a"][: i % 4] + [f"w{i}"]) for i in range(50)] + [("none", []), ("null", None)]
    entries = search.numbered(spark.createDataFrame(rows, "id string, stems array<string>")).localCheckpoint()
    blocks = search.posting_blocks(entries, search.statistics(entries))
    assert "hashpartitioning" not in blocks._jdf.queryExecution().executedPlan().toString()
    found = {(r.stem, r.id, r.tf, r.length) for r in search._unblocked(blocks).collect()}
    assert found == {(r.stem, r.id, r.tf, r.length) for r in search.postings(entries).collect()}
    mean = entries.where("size(stems) > 0").agg(F.avg(F.size("stems"))).first()[0]
    tops = {r.stem: r.top for r in blocks.groupBy("stem").agg(F.max("top").alias("top")).collect()}
    want = search.saturation(F.col("tf"), F.col("length"), F.lit(mean))
    assert {r.stem: round(r.w, 9) for r in search.postings(entries).groupBy("stem").agg(F.max(want).alias("w")).collect()} == {k: round(v, 9) for k, v in tops.items()}
