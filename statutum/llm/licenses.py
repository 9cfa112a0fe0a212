"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor folder.

Templates are whole licence texts and standard headers (files under ``licence_texts``) and one-sentence notices. A header of
several paragraphs is also a template by its first one. Weights are term counts times ``log((1 + T) / (1 + n)) + 1``, T being the number
of templates and n that of those with the term; a term that no template has weighs as for n = 0. So a cosine depends on
the two texts alone and not on how common a header is in the files.

1. Terms are runs of letters, digits and characters beyond ASCII, lower-cased; marks of comments are none of these and fall away.
   A line of a copyright holder (``Copyright (c) 2020``, ``(c) 2020``) counts as blank, in files and templates.
2. A file's units are: the whole text, its paragraphs (lines between blank ones), its single lines, and its longest runs of
   licence-like lines with only blank lines between. A line is licence-like if terms of the templates make at least ``COSINE`` of its
   length; headers wrapped in any way, with blank lines and comment marks, are such runs.
3. A unit names a licence if its best cosine with a template reaches ``COSINE``. A file's licence is that of the unit with the largest
   product of cosine and number of terms, ties going to the licence first in order of names, then to the earlier and shorter unit.
4. A file is a licence file if lines of units that name one hold ``FILE_SHARE`` of its terms or more, or if it is named like one and
   names a licence. A folder's licence is that of its best licence file (cosine, then path).
5. A file that names no licence inherits that of its nearest ancestor folder that has one, by an equality join of its
   ancestors' paths; the join's other side has one row for each licensed folder.

Every text is read whole. Null and empty texts name no licence but inherit. A null path has no folders. Equal rows give equal rows; other
columns are ignored. An empty table gives no rows, no templates no licences. Templates are few: more than ``MOST_BYTES`` of them, or a table
of their terms by templates above ``MOST_CELLS``, is refused.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .common import bounded_batches, materialize

COSINE, FILE_SHARE = 0.75, 0.5
#: Bytes of templates, and cells of the table of terms by templates, at most; terms of texts compared at once, about.
MOST_BYTES, MOST_CELLS, CHUNK = 4 << 20, 16 << 20, 1 << 16
#: Names of licence files, as a pattern over lower-cased names.
LICENCE_NAME = r"^(licen[cs]e|copying|unlicense)([.-].*)?$"

#: Names by which notices of one sentence call the licences.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal Public Domain Dedication", "CC0 1.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0",),
    "GPL": ("GNU General Public License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "MIT": ("MIT License",),
    "MPL-1.1": ("Mozilla Public License, version 1.1",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "Unlicense": ("Unlicense",),
}
#: Sentences of notices that name a licence.
SENTENCES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This software is distributed under the terms of the {}.")
RESERVED = "All rights reserved."

_FOLDER = Path(__file__).parent / "licence_texts"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b == 10 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SIGN = "©".encode()


def templates() -> dict[str, tuple[str, ...]]:
    """The texts, headers and notices that come with the library, by licence."""
    found: dict[str, list[str]] = {"Proprietary": [RESERVED]}
    for path in sorted(_FOLDER.glob("*/*.txt")):
        found.setdefault(path.stem.partition("+")[0], []).append(path.read_text(encoding="utf-8"))
    for licence, names in NAMES.items():
        texts = found.setdefault(licence, [])
        texts += [sentence.format(name) for name in names for sentence in SENTENCES]
        texts.append(f"SPDX-License-Identifier: {licence}")
    return {licence: tuple(texts) for licence, texts in sorted(found.items())}


def lines_of(text: bytes | None) -> list[list[bytes]]:
    """Terms of each line of a text; a line of a copyright holder has none."""
    out = [line.split() for line in (text or b"").translate(_TABLE).split(b"\n")]
    return [[] if _holder(terms) else terms for terms in out]


def _holder(terms: list[bytes]) -> bool:
    marks = (b"c", _SIGN)
    year = lambda t: len(t) == 4 and t.isdigit()
    if len(terms) < 2:
        return False
    if terms[0] == b"copyright":
        return terms[1] in marks or year(terms[1])
    return terms[0] in marks and (year(terms[1]) or terms[1] == b"copyright")


def bags_of(texts: Iterable[str]) -> Iterator[Counter]:
    """Term counts of the templates of one licence: of each text, and of a header's first paragraph."""
    for text in texts:
        lines = lines_of(text.encode())
        whole = Counter(t for line in lines for t in line)
        if whole:
            yield whole
        paragraphs: list[list[bytes]] = [[]]
        for line in lines:
            if line:
                paragraphs[-1] += line
            elif paragraphs[-1]:
                paragraphs.append([])
        paragraphs = [p for p in paragraphs if p]
        if 1 < len(paragraphs) <= 4 and whole.total() < 250:
            yield Counter(paragraphs[0])


class _Numbers(dict):
    """Numbers of terms: those of the templates from 0, others from a hash; remembers a bounded number of them."""

    def __init__(self, vocabulary: list[bytes], most: int = 300_000):
        super().__init__((t, i) for i, t in enumerate(vocabulary))
        self.most, self.first = most, len(vocabulary)

    def __missing__(self, term: bytes) -> int:
        value = self.first + (xxhash.xxh3_64_intdigest(term) >> 2)
        if len(self) < self.most:
            self[term] = value
        return value


class Matcher:
    """Licences of texts under given templates."""

    def __init__(self, known: dict[str, Iterable[str]]):
        bags = [(name, bag) for name in sorted(known) for bag in bags_of(known[name])]
        frequency = Counter(t for _, bag in bags for t in bag)
        vocabulary = sorted(frequency)
        if len(vocabulary) * len(bags) > MOST_CELLS:
            raise ValueError(f"{len(vocabulary)} terms by {len(bags)} templates exceed {MOST_CELLS} cells")
        self.names = [name for name, _ in bags]
        self.number = _Numbers(vocabulary)
        self.unseen = math.log(1 + len(bags)) + 1
        self.idf = np.array([math.log((1 + len(bags)) / (1 + frequency[t])) + 1 for t in vocabulary] + [self.unseen])
        self.table = np.zeros((len(vocabulary), len(bags)))
        for j, (_, bag) in enumerate(bags):
            for t, n in bag.items():
                self.table[self.number[t], j] = n * self.idf[self.number[t]]
        self.table /= np.sqrt((self.table**2).sum(axis=0))

    def cosines(self, terms: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For units of terms: whether they are licence-like, their best cosine (0 if not) and its template.

        Templates have length 1, so no cosine exceeds the share of a unit's length that lies in terms of the templates: units below
        ``COSINE`` in that need no comparison.
        """
        known_terms = len(self.idf) - 1
        order = np.lexsort((terms, unit))
        terms, unit = terms[order], unit[order]
        first = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (unit[1:] != unit[:-1]))))
        count = np.diff(np.append(first, len(terms)))
        terms, unit = terms[first], unit[first]
        known = terms < known_terms
        weight = count * self.idf[np.minimum(terms, known_terms)]
        square = np.bincount(unit, weight * weight, units)
        within = np.bincount(unit[known], (weight * weight)[known], units)
        like = (within > 0) & (within * (1 + 1e-9) >= COSINE * COSINE * square)
        best, which = np.zeros(units), np.zeros(units, np.int64)
        chosen = known & like[unit]
        terms, unit, weight = terms[chosen], unit[chosen], weight[chosen]
        edges = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))) if len(unit) else np.empty(0, np.int64)
        for k in range(0, len(edges), 512):
            part = edges[k : k + 512]
            stop = edges[k + 512] if k + 512 < len(edges) else len(unit)
            dots = np.add.reduceat(weight[part[0] : stop, None] * self.table[terms[part[0] : stop]], part - part[0], axis=0)
            at = unit[part]
            dots = np.round(dots / np.sqrt(square[at])[:, None], 9)
            which[at] = dots.argmax(axis=1)
            best[at] = dots[np.arange(len(at)), which[at]]
        return like, best, which

    def of(self, texts: list[bytes | None]) -> list[tuple[str | None, float | None, int | None, int | None, bool]]:
        """Licence, cosine, first and last line and whether the text is a licence file, for each text."""
        out: list = []
        held: list[list[list[bytes]]] = []
        size = 0
        for text in texts:
            held.append(lines_of(text))
            size += sum(map(len, held[-1]))
            if size >= CHUNK:
                out += self._of(held)
                held, size = [], 0
        return out + (self._of(held) if held else [])

    def _of(self, texts: list[list[list[bytes]]]) -> list:
        none = (None, None, None, None, False)
        sizes = np.array([len(line) for lines in texts for line in lines], np.int64)
        if not self.names or not sizes.sum():
            return [none] * len(texts)
        flat = [t for lines in texts for line in lines for t in line]
        terms = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        per_text = np.array([len(lines) for lines in texts])
        text_of = np.repeat(np.arange(len(texts)), per_text)
        number = np.arange(len(sizes)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        full = np.flatnonzero(sizes)  # lines with terms
        sizes, text_of, number = sizes[full], text_of[full], number[full]
        other_text = np.concatenate(([True], text_of[1:] != text_of[:-1]))
        gap = np.concatenate(([True], full[1:] != full[:-1] + 1))
        like, *lines = self.cosines(terms, np.repeat(np.arange(len(full)), sizes), len(full))
        found = [(np.arange(len(full)), *lines)]
        runs = np.cumsum(other_text | ~like | np.concatenate(([True], ~like[:-1]))) - 1
        paragraphs = np.cumsum(other_text | gap) - 1
        for unit in (runs, paragraphs, np.cumsum(other_text) - 1):
            found.append((unit, *self.cosines(terms, np.repeat(unit, sizes), int(unit[-1]) + 1)[1:]))
        best: dict[int, tuple] = {}
        licensed = np.zeros(len(full), bool)
        for unit, cosine, which in found:
            licensed |= cosine[unit] >= COSINE
            if not (cosine >= COSINE).any():
                continue
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            last = np.append(first[1:], len(unit)) - 1
            words = np.add.reduceat(sizes, first)
            for k in np.flatnonzero(cosine >= COSINE).tolist():
                key = (-round(cosine[k] * words[k], 6), self.names[which[k]], int(number[first[k]]), int(number[last[k]]), float(cosine[k]))
                at = int(text_of[first[k]])
                best[at] = min(best.get(at, key), key)
        total = np.bincount(text_of, sizes, len(texts))
        within = np.bincount(text_of, sizes * licensed, len(texts))
        return [(b[1], b[4], b[2], b[3], bool(within[i] >= FILE_SHARE * total[i])) if (b := best.get(i)) else none for i in range(len(texts))]


def parents(path: Column) -> Column:
    """Folders of a path, nearest first, with their depth: ``array<struct<depth, folder>>``."""
    parts = F.split(path, "/")
    return F.when(path.isNull(), F.array().cast("array<struct<depth:int,folder:string>>")).otherwise(
        F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.struct(k.cast("int").alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("folder")))
    )


def scan(files: DataFrame, known: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """``doc_id, path, licence, cosine, line, last_line, inherited_from`` for every row of ``files(doc_id, path, text)``.

    ``line`` and ``last_line`` are those of the unit that names the licence, from 0; ``inherited_from`` is the folder that gave the
    licence, else null. ``known`` has the texts of each licence, by default ``templates()``.
    """
    known = templates() if known is None else {k: tuple(v) for k, v in known.items()}
    if sum(len(t.encode()) for texts in known.values() for t in texts) > MOST_BYTES:
        raise ValueError(f"templates of more than {MOST_BYTES} bytes")
    Matcher(known)  # refuses what is too large here, not in a task
    bounded_batches(files.sparkSession)
    shared = files.sparkSession.sparkContext.broadcast(pickle.dumps(known))
    made: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(pickle.loads(shared.value)))
        for batch in batches:
            licence, cosine, line, last, whole = zip(*made[0].of(batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((),) * 5
            arrays = [pa.array(licence, pa.string()), pa.array(cosine, pa.float64()), pa.array(line, pa.int64()), pa.array(last, pa.int64()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), *arrays], ["doc_id", "path", "own", "cosine", "line", "last_line", "whole"])

    raw = files.select("doc_id", "path", F.col("text").cast("binary").alias("text"))
    added = [StructField("own", StringType()), StructField("cosine", DoubleType()), StructField("line", LongType()), StructField("last_line", LongType()), StructField("whole", BooleanType())]
    found = materialize(raw.mapInArrow(run, StructType([*raw.drop("text").schema.fields, *added])), "licences")
    name = F.lower(F.substring_index("path", "/", -1))
    licence_files = found.where(F.col("path").isNotNull() & F.col("own").isNotNull() & (F.col("whole") | name.rlike(LICENCE_NAME)))
    by_folder = licence_files.withColumn("folder", parents(F.col("path"))[0]["folder"]).groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own")).alias("b"))
    by_folder = by_folder.select("folder", F.col("b.own").alias("licence"))
    up = found.where("own is null").select("path").distinct().select("path", F.explode(parents(F.col("path"))).alias("p")).select("path", "p.depth", "p.folder")
    nearest = up.join(by_folder, "folder").groupBy("path").agg(F.max(F.struct("depth", "folder", "licence")).alias("n"))
    out = found.join(nearest, "path", "left")
    inherited = F.col("own").isNull()
    return out.select("doc_id", "path", F.coalesce("own", "n.licence").alias("licence"), "cosine", "line", "last_line", F.when(inherited, F.col("n.folder")).alias("inherited_from"))
