import random

import pytest
from pyspark.sql import functions as F

from statutum import storage
from statutum.functions.text import stems
from statutum.operators import matching, search, sinks

WORDS = [f"{a}{b}" for a in ("kor", "lim", "dun", "pas", "wer") for b in ("ta", "no", "bi")]


def entries(spark, n, seed=1):
    rng = random.Random(seed)
    pick = lambda: WORDS[min(int(rng.expovariate(0.4)), len(WORDS) - 1)]
    rows = [(f"e:{i}", rng.choice(("act", "draft")), " ".join(pick() for _ in range(rng.randint(0, 9))), f"DU/{i}", rng.choice((None, "rada")), rng.choice(("a", "b", "c")), [f"n{i % 97}"] if i % 3 else None) for i in range(n)]
    rows += [("odd:1", "act", None, None, None, None, ["korta"]), ("odd:2", "act", "", None, None, "a", []), ("odd:3", "act", "korta " * 3000, None, None, "a", None)]
    frame = spark.createDataFrame(rows, "id string, kind string, title string, eli string, initiator string, stage string, identifiers array<string>")
    return frame.withColumn("act_type", F.lit(None).cast("string")).withColumn("stems", stems(F.col("title"))).repartition(5)


def answers(found):
    hits = [(r.id, round(r.score, 9), r.highlight) for r in found["hits"].collect()]
    return hits, found["total"].first().total, sorted(map(tuple, found["facets"].collect()), key=str)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_pages_by_blocks_equal_those_of_everything(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(search, "BLOCK_BITS", bits)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 2)
    e = entries(spark, 400)
    sinks.publish_index(e, str(tmp_path))
    live = sinks.live_index(spark, str(tmp_path))
    cases = [("korta werbi", {}), ("korta korta limno", {"offset": 7, "size": 11}), ("werbi", {"kinds": ("draft",)}), ("korta", {"stages": ("c",), "initiators": ("rada",), "size": 100}), ("n5", {}), ("korta", {"offset": 395, "size": 100}), ("nothing", {}), ("  ", {"size": 9}), ("o na", {})]
    for text, how in cases:
        assert answers(search.search(live.entries, text, index=live, **how)) == answers(search.search(e, text, **how)), text


def test_few_blocks_are_read(spark, tmp_path, monkeypatch):
    """A stem whose best titles stand in a few blocks: others are not read, and the scan is told which stems and blocks to read."""
    monkeypatch.setattr(search, "BLOCK_BITS", 3)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 4)
    rows = [(f"e:{i:04d}", "korta " * (5 if i < 20 else 1) + "limno " * (0 if i < 20 else 9)) for i in range(800)]
    e = spark.createDataFrame(rows, "id string, title string").coalesce(1).select("id", F.lit("act").alias("kind"), "title", F.lit(None).cast("string").alias("eli"), *(F.lit(None).cast("string").alias(c) for c in ("initiator", "stage", "act_type")), F.array("id").alias("identifiers"), stems(F.col("title")).alias("stems"))
    sinks.publish_index(e, str(tmp_path))
    live = sinks.live_index(spark, str(tmp_path))
    ranked = search.Ranked(live, "korta", {})
    assert ranked.bounds().count() == 100 and len(ranked.chosen(10)) <= 4
    plan = search.search(live.entries, "korta", size=10, index=live)["hits"]._jdf.queryExecution().toString()
    assert "EqualTo(stem,kor" in plan or "In(stem" in plan
    assert "In(block" in plan
    assert [r.id for r in search.search(live.entries, "korta", size=10, index=live)["hits"].collect()] == [f"e:{i:04d}" for i in range(10)]


def test_alias_keeps_two_versions(spark, tmp_path):
    e = entries(spark, 5)
    paths = [sinks.publish_index(e, str(tmp_path), "ix") for _ in range(4)]
    assert sinks._versions(spark, str(tmp_path), "ix") == [(4, paths[3]), (3, paths[2])]
    assert sinks.live_index(spark, str(tmp_path), "ix").entries.count() == 8


def test_run_folder_goes(spark):
    with storage.run_folder(spark) as folder:
        assert storage.materialize(spark.range(5), "t").count() == 5
        assert search.search(entries(spark, 30), "korta")["total"].first().total > 0
        assert storage.shared_path(spark, "x").startswith(folder)
    assert not storage.shared_path(spark, "x").startswith(folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder).count()


@pytest.mark.parametrize("text_ids", [False, True])
def test_interests_by_bits_equal_plain(spark, text_ids):
    """Random items and interests of every kind, keywords of several stems, excluded ones, ids as numbers (below 0 too) and as text."""
    rng = random.Random(4)
    items = [(str(i) if text_ids else i - 100, rng.choice(("act", "draft")), str(i % 40), f"DU/{i % 60}" if i % 7 else None, rng.sample("abcdef", rng.randint(0, 5)) if i % 11 else None) for i in range(300)]
    interests = [(f"o{p % 3}", p, 1, "act", f"DU/{rng.randrange(80)}", rng.random() < 0.3, None) for p in range(12) for _ in range(4)]
    interests += [(f"o{p % 3}", p, 1, "draft", str(rng.randrange(50)), rng.random() < 0.3, None) for p in range(12) for _ in range(3)]
    for p in range(12):
        for _ in range(4):
            w = rng.sample("abcdefz", rng.randint(0, 3))
            interests.append((f"o{p % 3}", p, 1, "keyword", " ".join(w), rng.random() < 0.25, w + w[:1] if w else None))
    want, refused = set(), set()
    for o, p, v, kind, value, out, w in interests:
        for i, k, subject, eli, s in items:
            if kind == "act" and k == "act" and eli == value or kind == "draft" and k == "draft" and subject == value or kind == "keyword" and w and s is not None and set(w) <= set(s):
                refused.add((i, p)) if out else want.add((i, o, p, v, kind, value))
    frame = spark.createDataFrame(items, f"item_id {'string' if text_ids else 'long'}, kind string, subject string, eli string, stems array<string>")
    asked = spark.createDataFrame(interests, "owner_id string, profile_id long, version int, kind string, value string, excluded boolean, stems array<string>")
    got = matching.interested_profiles(frame.repartition(4), asked).select("item_id", "owner_id", "profile_id", "version", "kind", "value").collect()
    assert sorted(map(tuple, got)) == sorted(x for x in want if (x[0], x[2]) not in refused)
