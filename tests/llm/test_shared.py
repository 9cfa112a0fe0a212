"""Shared helpers, the registered queries as a whole, and the pipeline."""

import random

import pyarrow as pa
import pytest

from statutum.llm import common
from statutum.llm.queries import QUERIES, SQL

from .helpers import components, prose


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in components(sorted(nodes | {300}), edges).items() if n in nodes}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_go_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [1, 2, 3]), ([], []), ([2], [4]), ([2, 3], [5, 6]))]
    assert [(k, t.column("v").to_pylist()) for k, t in common.groups(iter(batches), ["k"])] == [((1,), [1, 2]), ((2,), [3, 4, 5]), ((3,), [6])]


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_thirteen_operators_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)] and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = QUERIES[name](spark, sf_dir)
    found = con.execute(SQL[name])
    order = [[c[0] for c in found.description].index(c) for c in frame.columns]
    assert sorted(map(str, (tuple(r) for r in frame.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


def small(spark, tmp_path):
    """Documents of which every stage has something to drop."""
    rng = random.Random(6)
    item = prose(rng, 20)
    docs, labels = [], []
    for i in range(300):
        text = prose(rng, 60)
        if i % 10 == 1:
            text = " ".join(w + " badword" if k % 9 == 0 else w for k, w in enumerate(text.split()))
        if i % 10 == 2:
            text = docs[i - 2][1] + " end"
        if i % 10 == 3:
            text = text + " " + item
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        if i < 200:
            labels.append((i, 1, int(i % 10 == 1)))
    docs += [(900, None, None, None, None), (901, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    from .test_decontamination import brute as contamination
    from .test_near import brute as near

    all_docs = small(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs = common.materialize(docs, name)
        kept.append([r.doc_id for r in docs.collect()])
    toxic, unlike, clean, mixed, written = kept
    assert {i for i, *_ in all_docs} - set(toxic) == {i for i in range(300) if i % 10 == 1}
    texts = {i: t for i, t, *_ in all_docs}
    assert sorted(unlike) == [i for i, _, _, keep in near([(i, texts[i]) for i in toxic]) if keep]
    assert sorted(clean) == sorted(i for i, _, _, _, bad in contamination([(i, texts[i]) for i in unlike], [(1, spark.read.parquet(f"{sf}/benchmark.parquet").first().text)]) if not bad)
    assert set(mixed) <= set(clean) and sorted(written) == sorted(mixed) and len(mixed) > len(clean)
    assert max(mixed.count(i) for i in clean) <= 2
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(written)


def test_pipeline_drops_near_copies_of_either_measure(spark, tmp_path):
    """A long addition is near by five words and 0.80 alone, scattered edits by three words and 0.85 alone; a chain of both is one group."""
    import corpus_pipeline

    from .test_near import shingles

    words = [f"w{i}" for i in range(400)]
    added = words + [f"n{i}" for i in range(95)]
    scattered = [f"e{i}" if i % 40 == 20 else w for i, w in enumerate(words)]
    chain = [f"e{i}" if i % 40 == 20 else w for i, w in enumerate(added)]
    other = [f"o{i}" for i in range(300)]
    texts = {i: " ".join(t) for i, t in enumerate((words, added, scattered, chain, other))}
    like = lambda a, b, n: len(shingles(texts[a], n) & shingles(texts[b], n)) / len(shingles(texts[a], n) | shingles(texts[b], n))
    assert like(0, 1, 5) >= 0.8 and like(0, 1, 3) < 0.85 and like(0, 2, 3) >= 0.85 and like(0, 2, 5) < 0.8
    assert like(1, 3, 3) >= 0.85 and max(like(0, 3, 5), like(2, 3, 3)) < 0.85
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(4, texts[4], "en", "s", 0), (7, None, "en", "s", 0), (8, "", "en", "s", 0), (None, texts[0], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()), key=str) == [0, 4, 4, 7, 8, None]


def test_pipeline_carries_columns_of_any_name(spark, tmp_path):
    """Columns named like those of the operators, or with odd characters, keep their values through every stage."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    small(spark, tmp_path)
    names = ["score", "predicted", "held_out", "contamination", "copies", "copy_", "taken", "target", "size", "text_hash", "h", "h_", "i", "s", "spans", "rest", "component_id", "kept", "odd`name.x, y"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs, plain = stage(spark, docs, str(tmp_path)), stage(spark, plain, str(tmp_path))
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in plain.collect()), name
        if k < len(corpus_pipeline.STAGES) - 1:
            docs, plain = common.materialize(docs, name), common.materialize(plain, name)
            assert docs.columns == columns
            assert all(r[n] == f"{n}:{r.doc_id}" for r in docs.collect() for n in names), name


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            docs = common.materialize(docs, name)
    assert docs.count() == 0
