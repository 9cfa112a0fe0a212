"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Texts are normalised to lower-case words (A-Z lowered; ASCII other than letters and digits separates, all other
characters are word characters) joined by single spaces. The automaton holds every window of ``WINDOW`` consecutive words
of every item, an item of fewer words being one window, each between spaces so that only whole words match. It is built
from the items, a test set, in every Python worker. Its size is that of its distinct windows, which the items' words bound before any
text reaches the driver: at most ``MOST_WINDOWS`` of them belong to one automaton. A larger set is taken in parts, each
with an automaton and a pass over the texts of its own; the words hit are the union over parts, so the result is the same.
Every text is scanned once for each part and whole, inside the task that reads it: no shuffle, and nothing grows with the
corpus but the output.

Null and empty texts have no words, items without words no windows. Equal items each count. Windows may overlap. All columns and
rows stay; a column ``contamination`` of the input is replaced.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .common import bounded_batches, map_rows, materialize

WINDOW = 13
#: Windows of an automaton, at most. A worker holds one; measured, 100,000 windows of 13 words take 445 MB.
MOST_WINDOWS = 100_000

#: Bytes that are ASCII letters or digits are lowered, other ASCII becomes a space, all bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows_of(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Each distinct window, as text between spaces, with its number of words and the items that hold it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            found.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), set()))[1].add(item)
    return {k: (n, tuple(sorted(v))) for k, (n, v) in found.items()}


def spans_in_original(text: bytes, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in a text of runs of its words, given as first and last word."""
    normal = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], normal.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b]])) for a, b in words]


def _scan(windows: dict[str, tuple[int, tuple[str, ...]]]):
    made: list = []
    some = bool(windows)

    def automaton():
        if not made:
            import ahocorasick

            built = ahocorasick.Automaton()
            for text, (n, items) in windows.items():
                built.add_word(text, (len(text), n, items))
            if windows:
                built.make_automaton()
            windows.clear()
            made.append(built)
        return made[0]

    def one(text: bytes | None) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of words that are hit, as first and last word, and the items found."""
        words = words_of(text)
        if not words or not some:
            return [], set()
        normal = f" {b' '.join(words).decode('latin-1')} "
        hits = list(automaton().iter(normal))
        if not hits:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
        first = np.searchsorted(spaces, [end - size + 1 for end, (size, _, _) in hits])
        cover, items = np.zeros(len(words) + 1, np.int32), set()
        for at, (_, (_, n, names)) in zip(first.tolist(), hits, strict=True):
            cover[at] += 1
            cover[at + n] -= 1
            items.update(names)
        return runs_of(np.cumsum(cover)[:-1] > 0), items

    return one


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last places of the runs of true values."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


#: What a text holds; what passes over the texts leave for the next: runs of words and items found so far.
FOUND = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))), StructField("contaminated", BooleanType())])
SO_FAR = StructType([StructField("runs", BinaryType()), StructField("items", ArrayType(StringType()))])


def parts_of(items: DataFrame, window: int) -> list[DataFrame]:
    """``i, t`` of the items, in parts of about ``MOST_WINDOWS / 2`` windows, by a hash, if there are more than ``MOST_WINDOWS``."""
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0)))
    sized = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"), F.greatest(F.lit(1), F.coalesce(words, F.lit(0)) - window + 1).cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    if total <= MOST_WINDOWS:
        return [sized]
    count = -(-2 * total // MOST_WINDOWS)
    sized = materialize(sized.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(count))), "items")
    return [sized.where(F.col("part") == k) for k in range(count)]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``, with a struct ``contamination`` of what ``items(item_id, text)`` they hold.

    Its fields: ``n_words``, ``n_hit`` (words inside a window that occurs), ``items`` (sorted as strings), ``spans`` (character
    offsets in the original text, end exclusive) and ``contaminated`` (a twentieth of the words or more are hit).
    """
    bounded_batches(docs.sparkSession)
    out, names = docs.drop("contamination"), docs.drop("contamination").columns
    out = out.toDF(*(c if c == "text" else f"c{i}_" for i, c in enumerate(names)))
    parts = parts_of(items, window)
    for k, part in enumerate(parts):
        found = [(r.i or "", None if r.t is None else bytes(r.t)) for r in part.select("i", "t").collect()]
        out = _pass(out, windows_of(found, window), k > 0, k == len(parts) - 1)
        if k < len(parts) - 1:
            out = materialize(out, "contamination")  # one automaton at a time in a worker
    return out.toDF(*names, "contamination")


def _pass(docs: DataFrame, windows: dict[str, tuple[int, tuple[str, ...]]], later: bool, last: bool) -> DataFrame:
    """A pass over all texts with one automaton; passes after the first add to what those before found."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(windows))
    if later:
        docs = docs.withColumnRenamed("contamination", "so_far_")
    cache: list = []
    item_kind, span_kind = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", item_kind), ("spans", span_kind), ("contaminated", pa.bool_())]) if last else pa.struct([("runs", pa.binary()), ("items", item_kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(_scan(pickle.loads(shared.value)))
        for batch in batches:
            out = []
            before = batch.column("so_far_").to_pylist() if later else [None] * batch.num_rows
            for text, had in zip(batch.column("text").cast(pa.binary()).to_pylist(), before, strict=True):
                runs, found = cache[0](text)
                if had:
                    runs, found = runs + [tuple(x) for x in np.frombuffer(had["runs"], np.int64).reshape(-1, 2).tolist()], found | set(had["items"])
                if last:
                    n = len(words_of(text))
                    hit = np.zeros(n, bool)
                    for a, b in runs:
                        hit[a : b + 1] = True
                    n_hit = int(hit.sum())
                    spans = spans_in_original(text, runs_of(hit)) if n_hit else []
                    out.append({"n_words": n, "n_hit": n_hit, "items": sorted(found), "spans": [{"start": a, "end": b} for a, b in spans], "contaminated": n_hit > 0 and 20 * n_hit >= n})
                else:
                    out.append({"runs": np.array(runs, np.int64).tobytes(), "items": sorted(found)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, "contamination"])

    return map_rows(docs, run, [StructField("contamination", FOUND if last else SO_FAR)], "text", *(["so_far_"] if later else [])).drop("so_far_")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
