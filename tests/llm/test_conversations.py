import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from statutum.llm import conversation_trie as op
from statutum.llm.queries import op13_conversation_trie

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(rows):
    held = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            held[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in held.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain(paths):
    """A row for each node, subtrees walked node by node."""
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, who in members.items():
        saved = leaves = 0
        todo = [node]
        while todo:
            x = todo.pop()
            saved += (len(members[x]) - 1) * (len(x[-1][1]) if x else 0)
            leaves += not children[x]
            todo += children[x]
        ends = ",".join(str(c) for c in who if len(paths[c]) == len(node))
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def made(seed, n, pool, longest):
    """Conversations of few different turns, so that many begin alike; some are copies."""
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(0, 4 * n), n):
        for t in range(rng.randint(1, longest)):
            out.append((c, t, rng.choice(("user", "assistant")) if t % 3 else "user", rng.choice(pool)))
    copied = [r for r in out if r[0] == out[0][0]]
    return out + [(5 * n + k, t, r, x) for k in range(20) for _, t, r, x in copied]


ODD = [(1, None, "user", "a"), (1, 0, None, "b"), (1, 1, "user", None), (2, 3, "", "z"), (2, 3, "", "y"), (2, 3, "A", ""), (2, 3, "", "z"), (None, 1, "user", "lost"), (-7, 0, "user", "a"), (100, 5, "user", "ż€𝄞" * 30_000), (101, 5, "user", ""), (203, 0, "user", "only")]


@pytest.mark.parametrize("stretch", [512, 2])
def test_trie_equals_plain(spark, monkeypatch, stretch):
    monkeypatch.setattr(op, "STRETCH", stretch)
    monkeypatch.setattr(op, "IDS", 3)
    data = made(1, 120, ["", "x", "yy", "ż€"], 7) + ODD
    frame = spark.createDataFrame([(*r, "clash", 0) for r in data], KIND + ", depth string, owner int").repartition(7)
    turns = turns_of(data)
    assert rows(op.prefix_trie(frame)) == plain(turns)
    # ids below 0: the hundred of -7 begins at 0, as % leaves the sign
    turns = {c: v for c, v in turns.items() if c >= 0}
    assert rows(op.branched_trie(frame.where("conv_id >= 0 or conv_id is null"))) == plain(rebuilt(turns))


def test_one_long_conversation_and_one_common_path(spark, monkeypatch):
    """A conversation with a third of all turns, and a path that a third of the conversations share, equal the plain walk."""
    monkeypatch.setattr(op, "STRETCH", 16)
    monkeypatch.setattr(op, "IDS", 10)
    data = [(50, t, "user", f"t{t % 3}") for t in range(300)] + [(c, t, "user", f"t{t % 3}") for c in range(60, 160) for t in range(3)] + made(2, 60, ["t0", "t1", "q"], 5)
    assert rows(op.prefix_trie(spark.createDataFrame(data, KIND))) == plain(turns_of(data))


def test_nothing_and_turnless(spark):
    assert rows(op.branched_trie(spark.createDataFrame([], KIND))) == []
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 2)  # loses its only turn, and its hundred has no first conversation
    data = [(lone, 0, "user", "gone")]
    assert rows(op.branched_trie(spark.createDataFrame(data, KIND))) == plain(rebuilt(turns_of(data))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_query_by_hand(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(op13_conversation_trie(spark, sf_dir)) == plain(rebuilt(turns_of(data)))
