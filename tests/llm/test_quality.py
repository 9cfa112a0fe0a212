import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from statutum.llm import quality as op
from statutum.llm.queries import op12_quality_rules

from .helpers import prose, split


def features(words):
    crc = [zlib.crc32(w.encode()) for w in words]
    return [(op.STEP + c) % op.BUCKETS for c in crc] + [((2 * op.STEP + a) % op.BUCKETS * op.STEP + b) % op.BUCKETS for a, b in zip(crc, crc[1:])]


def plain(docs, trusted):
    """Rows by hand; ``trusted`` are positions in ``docs``."""
    found = [Counter(features(split(t))) for _, t in docs]
    raw, good = sum(found, Counter()), sum((found[k] for k in trusted), Counter())
    out = []
    for (i, text), own in zip(docs, found):
        text = text or ""
        words = split(text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeat = len({k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)})
        lines = [x for x in text.split("\n") if split(x)]
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        m, total = sum(own.values()), 0
        for b, n in own.items():
            rarity = (sum(raw.values()) - m + op.BUCKETS) / (raw[b] - n + 1)
            total += n * math.floor(1000 * math.log((good[b] * rarity + op.BUCKETS) / (sum(good.values()) + op.BUCKETS)))
        out.append((i, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed, m, total, not failed and total >= op.THRESHOLD * m))
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_equals_plain(spark):
    rng = random.Random(5)
    junk = lambda n: " ".join(rng.choice(("###", "<a>", "|x|", "$$", "%%z")) + str(rng.randrange(40)) for _ in range(n))
    texts = [prose(rng, rng.choice((49, 50, 51, 200))) for _ in range(60)] + [junk(80) for _ in range(12)]
    texts += [None, "", " \n\t ", "ż€ 𝄞a\x0bb\x0cc\x1cd\x85e\xa0f " * 20, "a b c a b c", "a a a a", "a b", "x y z\nx y z\n\n\n  \nx y z \nx y z", (prose(rng, 60) + "\n") * 3, prose(rng, 150_000), "one two " * 40]
    docs = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (3, junk(60))]
    labels = [(i, 1) for i in range(0, 40, 2)] + [(3, 1), (3, 1), (None, 1), (61, 0), (999, 1), (5, None)]
    got = op.quality(spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, kept string, quality int").repartition(6), spark.createDataFrame(labels, "doc_id long, quality int"))
    good = {i for i, q in labels if q == 1 and i is not None}
    want = plain(docs, [k for k, (i, _) in enumerate(docs) if i in good])
    assert key(got.collect()) == key(want)
    mean = {r.junk: r.m for r in got.where("doc_id < 72 and doc_id <> 3").groupBy(F.expr("doc_id >= 60").alias("junk")).agg(F.avg(F.expr("ratio_sum / n_features")).alias("m")).collect()}
    assert mean[True] < mean[False]


def test_without_trusted_texts_base_rules_decide(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(1, prose(rng, 80)), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept, r.ratio_sum) for r in op.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {1: (False, True, 0), 2: (True, False, 0)}


def test_no_documents(spark):
    assert op.quality(spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([("a", 1)], "doc_id string, quality int")).count() == 0


def test_threshold_is_a_parameter(spark):
    docs = spark.createDataFrame([(i, prose(random.Random(i), 90)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    kept = [op.quality(docs, labels, threshold=t).where("kept").count() for t in (-100_000, -75, 100_000)]
    assert kept[0] == 30 and kept[0] >= kept[1] >= kept[2] == 0


def test_query_by_hand(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    docs, good = [(r.doc_id, r.text) for r in read("documents")], {r.doc_id for r in read("labels") if r.quality == 1}
    assert key(op12_quality_rules(spark, sf_dir).collect()) == key(plain(docs, [k for k, (i, _) in enumerate(docs) if i in good]))


def test_labels_are_met(spark):
    """Of the labelled texts that pass the base rules, nearly all good ones stay and most bad ones go."""
    sf = "/root/testdata/sf0.01"
    got = op12_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0)) and n[0, False] >= 0.6 * (n[0, False] + n.get((0, True), 0))
