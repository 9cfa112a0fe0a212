import random
import struct
import zlib

import numpy as np
import pytest

from statutum.llm import token_tables as op
from statutum.llm.common import shared_path
from statutum.llm.queries import op8_token_tables, tokenizer_path

from .helpers import prose

TEXTS = [None, "", " ", "  a", "a b  c", "a\n b", "Zażółć gęślą jaźń 🙂", "<|endoftext|> x", "a b  c", "x" * 5000, " lead", "trail ", "\x00\x01 y", "a 's 'll b", "12 345,678 !? -- ..."]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def brute(tokenizer, rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(3)
    texts = TEXTS + [prose(rng, 300) for _ in range(5)] + ["".join(rng.choice("ab .\n\t'é1🙂") for _ in range(60)) for _ in range(200)]
    encoder = op.Encoder(tokenizer_path())
    for _ in range(2):  # once with nothing remembered, once with it
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(raw, encoder.kind).tolist() == ids_of(tokenizer, text)[:-1], repr(text)


def test_round_trip_in_order(spark, tokenizer):
    rows = [(i * 3 - 10, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(4)
    got = sorted(tuple(r) for r in op.token_round_trip(docs, tokenizer_path()).collect())
    assert got == brute(tokenizer, rows)


def test_null_and_equal_ids(spark, tokenizer):
    rows = [(None, "b"), (7, "a"), (7, "a"), (7, "c d"), (-1, "e")]
    got = op.token_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, -1), (True, 7), (True, 7), (True, 7)]
    end = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in end] == [sum(n for _, n in end[:k]) for k in range(5)] and next(r for r in got if r.doc_id is None).start == 0


def test_layouts_agree_where_ids_are_equal(spark, tokenizer):
    """Documents of one id come in order of their texts, however the table is dealt out."""
    rows = [(7, prose(random.Random(i % 5), 1 + i % 5)) for i in range(40)] + [(3, "x y"), (9, None)]
    want = brute(tokenizer, sorted(rows, key=lambda r: (r[0], r[1] or "")))
    for seed in (1, 2, 3):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(seed + 1)
        assert sorted((tuple(r) for r in op.token_round_trip(docs, tokenizer_path()).collect()), key=lambda r: r[1]) == want


def test_full_shards_are_followed_by_others(spark, tokenizer, monkeypatch):
    """A task writes several shards, in order, none of which parts equal ids."""
    monkeypatch.setattr(op, "SHARD_BYTES", 0)
    rng = random.Random(8)
    rows = [(i // 3, prose(rng, 1 + i % 9)) for i in range(90)]
    folder = shared_path(spark, "tokens")
    shards = op.write_tables(spark.createDataFrame(rows, "doc_id long, text string"), folder, tokenizer_path())
    listed = shards.orderBy("shard").collect()
    assert len(listed) == 30 and [r.first_id for r in listed] == list(range(30)) == [r.last_id for r in listed] and {r.entries for r in listed} == {3}
    want = brute(tokenizer, sorted(rows))
    assert sorted((tuple(r) for r in op.read_tables(spark, shards).collect()), key=lambda r: r[1]) == want


def test_no_documents(spark):
    assert op.token_round_trip(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_look_ups(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    rows = [(i * 7, prose(rng, 1 + i % 40)) for i in range(300)] + [(7, "again"), (None, "none"), (-(1 << 62), "low")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    writer, encoder = op.Writer(2), op.Encoder(tokenizer_path())
    ordered = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    path = shared_path(spark, "shard")
    op.write_file(path, (x for part in ([*writer.add(r.doc_id, encoder.encode([r.text])[0])] for r in ordered) for x in part))
    with pytest.raises(ValueError, match="no shard"):
        op.Shard(path)
    writer = op.Writer(2)
    chunks = [x for r in ordered for x in writer.add(r.doc_id, encoder.encode([r.text])[0])] + list(writer.close())
    op.write_file(path, chunks)
    shard = op.Shard(path)
    assert len(shard.blocks) > 5 and shard.entries == 303
    for r in ordered:
        assert ids_of(tokenizer, r.text)[:-1] in [x.tolist() for x in shard.get(r.doc_id)]
    assert len(shard.get(7)) == 2 and shard.get(8) == [] and shard.get(1 << 60) == []
    assert np.mean([shard.may_hold(i) for i in range(100_000, 110_000)]) < 0.05
    assert [op.id_of(k) for k, _ in shard.scan()] == [r.doc_id for r in ordered]
    shard.close()


def test_query(spark, sf_dir, tokenizer):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(tuple(r) for r in op8_token_tables(spark, sf_dir).collect()) == brute(tokenizer, rows)
