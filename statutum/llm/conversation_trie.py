"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns, (role, text) each; the conversations that begin with it are its members and the smallest of them
owns it. A conversation that owns a node owns all that follows on its path, so what it owns is a suffix of its path, known by the depth where it
begins. With that depth a row of (conversation, depth) knows by itself what it adds to its node: the tokens that its conversation repeats from there on
(those of occurrences less those of owned nodes), whether its conversation ends in a leaf of its own, and whether the next node is its own.
One group-by of rows by node sums these, and no node is ever walked or joined with its subtree.

1. Turns become digests of 16 bytes and lengths in the task that reads them; texts travel no further, but those of turns with one number (ties).
2. Windows over each conversation number its turns, and run along its path: exclusive-or of hashes of (depth, digest) names the node at every
   depth by 16 bytes, a running sum counts tokens. They work in two levels, in stretches of ``STRETCH`` turns and over the stretches, so that a
   conversation with a third of all turns is dealt over many tasks.
3. Nodes are grouped twice, first for the owner, which marks where each conversation's own suffix begins, then for the sums. Both combine rows
   before the shuffle, so a node that a third of all conversations share sends a row from each task. The root has no rows; it is a total.
4. Of the conversations that end at a node, ids are joined in range-dealt, sorted stretches, and only these strings meet in one task, in order, to be
   hashed as they come: a node at which very many conversations end is never held.

Turns are in order of their number, null first; turns of one conversation with the same number by role, then text, null as empty. Repeated rows are repeated
turns. Rows without a conversation are left out. Empty and very long texts are turns like others. An empty table has no nodes, not even the
root. Other columns are ignored, whatever their names. Distinct sequences share a name with a chance of 2^-128 for a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shuffle_partitions

#: Turns in a stretch of a conversation; ids in one string of a node's ends.
STRETCH, IDS = 512, 20_000
NODE = ("depth", "k1", "k2")


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, place, a, b, tokens`` of every turn; ``place`` orders turns of one conversation with the same number."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    named = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    a, b = F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b")
    turns = materialize(named.select("conv_id", "turn", a, b, F.length("text").cast("long").alias("tokens")), "turns")
    tied = turns.groupBy("conv_id", "turn").agg((F.min("a") != F.max("a")).alias("several")).where("several").drop("several")
    tied = materialize(tied, "tied")
    if tied.isEmpty():
        return turns.withColumn("place", F.lit(0))
    same = (named["conv_id"] == F.col("c")) & named["turn"].eqNullSafe(F.col("t"))
    texts = named.join(tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t")), same, "left_semi").distinct()
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    places = texts.select("conv_id", "turn", a, b, F.row_number().over(order).alias("place"))
    same = F.expr("x.conv_id = y.conv_id and x.turn <=> y.turn and x.a = y.a and x.b = y.b")
    return turns.alias("x").join(places.alias("y"), same, "left").select("x.*", F.coalesce("y.place", F.lit(0)).alias("place"))


def running(rows: DataFrame, order: list, totals: dict[str, tuple]) -> DataFrame:
    """Running totals over each conversation's rows in an order, in two levels; ``stretch`` is not below that of rows before.

    ``totals`` has the aggregate, the column and how two totals are joined; the rows' own columns stay.
    """
    inside = Window.partitionBy("conv_id", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv_id", "stretch").agg(*(of(c).alias(n) for n, (of, c, _) in totals.items()))
    whole = whole.select("conv_id", "stretch", *(of(n).over(before).alias(f"{n}_before") for n, (of, _, _) in totals.items()))
    local = rows.select("*", *(of(c).over(inside).alias(n) for n, (of, c, _) in totals.items()))
    joined = local.join(whole, ["conv_id", "stretch"])
    return joined.select(*rows.columns, *(joint(F.col(n), F.coalesce(f"{n}_before", F.lit(0).cast("long"))).alias(n) for n, (_, _, joint) in totals.items()))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _differs(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, n, a, b, tokens``: the turns of every conversation with their numbers from 1."""
    turns = materialize(turn_digests(conversations).withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60)))), "placed")
    order = [F.asc_nulls_first("turn"), "place", "a", "b"]
    out = running(turns, order, {"n": (F.sum, F.lit(1).cast("long"), _plus)})
    return out.select("conv_id", "n", "a", "b", "tokens")


def branched(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations as branches of the first of their hundred: its first h turns, then their own after the first h.

    ``h`` is the unsigned crc32 of the decimal id modulo ``most``. Takes ``numbered`` turns; gives ``conv_id, depth, a, b, tokens`` and all ids,
    as a conversation may be left without turns.
    """
    turns = materialize(turns, "numbered")
    ids = turns.groupBy("conv_id").agg(F.max("n").alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % family
    ids = materialize(ids.select("conv_id", "own", h.alias("h"), base.alias("base")), "conversations")
    bases = ids.where("conv_id = base").select("base", F.col("own").alias("there"))
    taken = ids.join(bases, "base").select("conv_id", "base", F.least("h", "there").alias("taken")).where("taken > 0")
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("n") < most)).select(F.col("conv_id").alias("base"), "n", "a", "b", "tokens")
    first = heads.join(taken, "base").where("n <= taken").select("conv_id", F.col("n").alias("depth"), "a", "b", "tokens")
    own = turns.where(F.col("n") > h).join(taken.select("conv_id", "taken"), "conv_id", "left")
    own = own.select("conv_id", (F.col("n") - h + F.coalesce("taken", F.lit(0))).alias("depth"), "a", "b", "tokens")
    return first.unionByName(own), ids.select("conv_id")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends of nodes as strings of at most ``IDS`` ids, each with its node and first id."""
    node, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(NODE, node, strict=True), first=ids[0], ids=",".join(map(str, ids)))], schema=schema)

    schema = pa.schema([*((c, pa.int64()) for c in (*NODE, "first")), ("ids", pa.string())])
    for batch in batches:
        for *at, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if at != node or len(ids) == IDS:
                if ids:
                    yield row()
                node, ids = at, []
            ids.append(conv)
    if ids:
        yield row()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, which come in order."""
    node, state = None, None

    def row() -> dict:
        return dict(zip(NODE, node, strict=True), ends_sha256=state.hexdigest())

    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for *at, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if at != node:
                if state:
                    done.append(row())
                node, state = at, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if state:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """For each node of ``ends(depth, k1, k2, conv_id)`` the SHA-256 of its decimal ids, in order and comma-joined."""
    parts = shuffle_partitions(ends.sparkSession)
    dealt = ends.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    strings = dealt.mapInArrow(_strings, ", ".join(f"{c} long" for c in (*NODE, "first")) + ", ids string")
    met = strings.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")
    return met.mapInArrow(_hashes, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node of ``turns(conv_id, depth, a, b, tokens)`` and the root, over the conversations of ``ids(conv_id)``.

    Columns: ``conv_id`` (the owner), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the
    subtree), ``saved_tokens`` (tokens that members repeat in the subtree) and ``ends_sha256`` (of the members that end there).
    """
    bounded_batches(turns.sparkSession)
    x1, x2 = F.xxhash64("depth", "a", "b"), F.xxhash64("depth", "b", "a")
    rows = materialize(turns.select("conv_id", "depth", x1.alias("x1"), x2.alias("x2"), "tokens", F.floor(F.col("depth") / STRETCH).alias("stretch")), "turns")
    rows = running(rows, ["depth"], {"k1": (F.bit_xor, F.col("x1"), _differs), "k2": (F.bit_xor, F.col("x2"), _differs), "upto": (F.sum, F.col("tokens"), _plus)})
    before = (F.col("upto") - F.col("tokens")).alias("before")
    rows = materialize(rows.select("conv_id", *NODE, before, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "upto"), "paths")
    paths = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2", "upto")).alias("end"))
    paths = materialize(ids.join(paths, "conv_id", "left"), "ends")
    # owners: the node's smallest member, and whether some member goes on from it
    owners = rows.groupBy(*NODE).agg(F.min(F.struct("conv_id", "before")).alias("o"))
    inner = rows.where("depth > 1").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).groupBy(*NODE).agg(F.lit(True).alias("inner"))
    owners = materialize(owners.join(inner, [*NODE], "left").select(*NODE, F.col("o.conv_id").alias("owner"), F.col("o.before").alias("before"), F.col("inner").isNull().alias("leaf")), "owners")
    suffix = owners.groupBy(F.col("owner").alias("conv_id")).agg(F.min(F.struct("depth", "before")).alias("own"), F.max("leaf").alias("leaf"))
    conversations = paths.join(suffix, "conv_id", "left").select(
        "conv_id",
        F.col("end.depth").alias("length"),
        F.coalesce("own.depth", F.lit((1 << 62))).alias("own"),
        F.coalesce("own.before", "end.upto", F.lit(0).cast("long")).alias("repeated"),
        F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"),
    )
    conversations = materialize(conversations, "suffixes")
    joined = rows.join(conversations, "conv_id")
    child = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("own"))).cast("long")
    nodes = joined.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "own", "p1", "p2")).alias("o"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("repeated") - F.col("before"), F.lit(0).cast("long"))).alias("saved_tokens"),
    )
    nodes = materialize(nodes.select(*NODE, "o.*", "n_convs", "n_children", "n_leaves", "saved_tokens"), "nodes")
    # parents: the owner itself, but where its suffix begins
    above = owners.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    smallest = conversations.agg(F.min("conv_id")).first()[0]
    entry = nodes.where("depth > 1 and depth = own").join(above, ["depth", "p1", "p2"])
    inside = nodes.where("depth > 1 and depth > own").withColumn("parent_conv_id", F.col("conv_id"))
    top = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long"))
    columns = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(((F.col("length") > 0) & (F.col("own") <= 1)).cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("repeated").alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    root = root.where("n_convs > 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens")
    every = root.unionByName(top.select(columns)).unionByName(entry.select(columns)).unionByName(inside.select(columns))
    ends = paths.select(*(F.coalesce(f"end.{c}", zero).alias(c) for c in NODE), "conv_id")
    out = every.join(ends_digests(ends), [*NODE], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` as they are; see ``trie``."""
    turns = materialize(numbered(conversations), "numbered")
    return trie(turns.withColumnRenamed("n", "depth"), turns.select("conv_id").distinct())


def branched_trie(conversations: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """The trie of conversations rebuilt as branches; see ``branched`` and ``trie``."""
    return trie(*branched(numbered(conversations), family, most))
