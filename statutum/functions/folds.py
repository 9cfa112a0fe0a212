"""Folds over arrays whose time does not grow with the square of the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that a fold takes at once, at least.
CHUNK = 64


def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def running(items: Column, start: Column, step, emit, kind: str) -> Column:
    """``emit(state, item)`` for every item, the state being a fold of ``step`` over the items before it; ``kind`` is what is emitted.

    A fold that appends to one array copies it each time. Here the states at every chunk's start are folded first, then each chunk by
    itself, so that no array that grows is longer than a chunk or the number of chunks.
    """
    none = F.array().cast(f"array<{kind}>")

    def chunked(xs: Column, width: Column) -> Column:
        part = lambda k: F.slice(xs, k * width + 1, width)
        places = F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1)
        ahead = lambda acc, k: bound(F.aggregate(part(k), acc["s"], step), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out")))
        states = F.aggregate(F.slice(places, F.lit(1), F.size(places) - 1), F.struct(start.alias("s"), F.array(start).alias("out")), ahead, lambda acc: acc["out"])
        one = lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out"))
        return bound(states, lambda st: F.flatten(F.transform(places, lambda k: F.aggregate(part(k), F.struct(st[k].alias("s"), none.alias("out")), one, lambda acc: acc["out"]))))

    whole = lambda xs: bound(F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(xs))).cast("int")), lambda width: chunked(xs, width))
    return F.when(F.size(items) > 0, bound(items, whole)).otherwise(none)
