import math
import random
import textwrap
from collections import Counter

import pytest

from statutum.llm import licenses as op
from statutum.llm.queries import op6_license_scan

from .helpers import prose

KNOWN = op.templates()


def lines_of(text):
    """Terms by line, by hand."""
    out = []
    for line in (text or "").split("\n"):
        terms = "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in line).split()
        mark = terms[:1] == ["copyright"] and terms[1:2] and (terms[1] in ("c", "©") or len(terms[1]) == 4 and terms[1].isdigit())
        sign = terms[:1] and terms[0] in ("c", "©") and terms[1:2] and (terms[1] == "copyright" or len(terms[1]) == 4 and terms[1].isdigit())
        out.append([] if mark or sign else terms)
    return out


def weigher(known):
    bags = []
    for name in sorted(known):
        for text in known[name]:
            lines = lines_of(text)
            whole = Counter(t for line in lines for t in line)
            if not whole:
                continue
            bags.append((name, whole))
            parts = [p.split() for p in "\n".join(" ".join(x) for x in lines).split("\n\n")]
            parts = [p for p in parts if p]
            if 1 < len(parts) <= 4 and sum(whole.values()) < 250:
                bags.append((name, Counter(parts[0])))
    df = Counter(t for _, bag in bags for t in bag)
    idf = lambda t: math.log((1 + len(bags)) / (1 + df[t])) + 1
    vec = lambda bag: {t: n * idf(t) for t, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, vec(bag), norm(vec(bag))) for name, bag in bags]

    def best(terms):
        v = vec(Counter(terms))
        n, inside = norm(v), math.sqrt(sum(x * x for t, x in v.items() if df[t]))
        if not n or inside < op.COSINE * n - 1e-9:
            return False, 0.0, ""
        c, name = min((-round(sum(x * w.get(t, 0) for t, x in v.items()) / n / m, 9), name) for name, w, m in vectors)
        return True, -c, name

    return best


def own(text, best):
    lines = [(k, t) for k, t in enumerate(lines_of(text)) if t]
    if not lines:
        return None, False
    units = [[x] for x in lines] + [lines]
    paragraphs, runs = [], []
    for k, terms in lines:
        if paragraphs and paragraphs[-1][-1][0] == k - 1:
            paragraphs[-1].append((k, terms))
        else:
            paragraphs.append([(k, terms)])
        like = best(terms)[0]
        if runs and like and runs[-1][0]:
            runs[-1][1].append((k, terms))
        else:
            runs.append((like, [(k, terms)]))
    found, licensed = [], set()
    for unit in units + paragraphs + [r for _, r in runs]:
        terms = [t for _, line in unit for t in line]
        _, c, name = best(terms)
        if c >= op.COSINE:
            found.append((-round(c * len(terms), 6), name, unit[0][0], unit[-1][0], c))
            licensed |= {k for k, _ in unit}
    share = sum(len(t) for k, t in lines if k in licensed) / sum(len(t) for _, t in lines)
    return (min(found) if found else None), share >= op.FILE_SHARE


def brute(rows, known=KNOWN):
    best = weigher(known)
    seen = {}
    for _, _, text in rows:
        if text not in seen:
            seen[text] = own(text, best)
    folders = {}
    for _, path, text in rows:
        got, whole = seen[text]
        name = (path or "").rpartition("/")[2].lower()
        if path is not None and got and (whole or name.split(".")[0].split("-")[0] in ("license", "licence", "copying", "unlicense")):
            folder = path.rpartition("/")[0]
            folders[folder] = min(folders.get(folder, (1, "", "")), (-got[4], path, got[1]))
    out = []
    for i, path, text in rows:
        got, _ = seen[text]
        if got:
            out.append((i, got[1], round(got[4], 6), got[2], got[3], None))
            continue
        parts, given = (path.split("/") if path is not None else []), None
        for k in range(len(parts) - 1, -1, -1):
            if path is not None and "/".join(parts[:k]) in folders:
                given = "/".join(parts[:k])
                break
        out.append((i, folders[given][2] if given is not None else None, None, None, None, given))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.licence, r.cosine and round(r.cosine, 6), r.line, r.last_line, r.inherited_from) for r in frame.collect()), key=str)


def full(licence):
    return max(KNOWN[licence], key=len)


def header(licence):
    return max((t for t in KNOWN[licence] if 150 < len(t) < 1000), key=len)


def commented(text, mark, width=60):
    return "\n".join((mark + line).rstrip() for part in text.split("\n") for line in textwrap.wrap(part, width) or [""])


MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
ROWS = [
    (1, "a/LICENSE", MIT + "\n" + "permission words that say more " * 5), (2, "a/x.py", "code\nmore code"), (3, "a/b/c.py", None), (4, "a/b/COPYING", GPL), (5, "a/b/d/e.py", ""), (6, "f.py", "plain"), (7, None, "plain"), (8, None, MIT), (9, "g/h.py", f"# {MIT}\ncode\n" + "z " * 50), (10, "g/i.py", "nothing"),
    (11, "a/b/COPYING", GPL), (12, "", "x"), (13, "LICENCE.txt", "All rights reserved"), (14, "j//k.py", "q"), (None, "a/x.py", "z"), (15, "k/LICENSE", full("BSD-3-Clause")), (16, "k/l/m.c", "int main() { return 0; }"),
    (17, "n/o.py", "#!/bin/sh\n" + commented("Copyright 2020 Somebody\n" + header("Apache-2.0"), "# ") + "\n\nimport os\n" + "call(argument)\n" * 30), (18, "n/p.py", "Copyright (c) 2001\n© 2002 x\n(c) 2003"), (19, "q.txt", "intro zzqx of foo\nThis work is licensed under\nthe MIT License.\nblorp things qqq"),
]


def test_equals_brute_force(spark):
    files = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id long, path string, text string, licence string, `odd``name` int").repartition(3)
    out = got(op.scan(files))
    assert out == brute(ROWS)
    by_id = {r[0]: r for r in out if r[0] is not None}
    assert by_id[2][1] == "MIT" and by_id[2][5] == "a" and by_id[3][1] == "GPL-3.0" and by_id[5][5] == "a/b" and by_id[9][1] == "MIT" and by_id[10][1] == "Proprietary" and by_id[7][1] is None
    assert by_id[15][1] == by_id[16][1] == "BSD-3-Clause" and by_id[16][5] == "k" and by_id[17][1] == "Apache-2.0" and by_id[18][1::4] == ("Apache-2.0", "n") and by_id[19][1:2] + by_id[19][3:5] == ("MIT", 1, 2)


def test_one_header_in_most_files(spark):
    """However many files carry the same header, none of them loses its licence."""
    rng = random.Random(1)
    for text, licence in ((MIT, "MIT"), (commented(header("Apache-2.0"), "// "), "Apache-2.0"), (commented(header("GPL-3.0"), " * "), "GPL-3.0")):
        rows = [(i, f"p{i % 3}/f{i}.py", (text + "\n" if i % 10 else "") + prose(rng, 40)) for i in range(200)] + [(200, "p0/LICENSE", full(licence)), (201, "p0/q/plain.py", "nothing")]
        out = got(op.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)))
        assert out == brute(rows)
        named = {r[0]: r for r in out}
        assert all(named[i][1] == licence for i in range(200) if i % 10) and named[201][1] == licence and named[201][5] == "p0"


@pytest.mark.parametrize("licence", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC", "CC0-1.0", "Unlicense"])
def test_whole_texts_are_named_however_wrapped(licence):
    texts = [commented(f"Copyright (c) 2019 A. Author\n{full(licence)}", mark, width) for mark in ("", "# ", " * ", "// ") for width in (50, 72, 100)]
    assert {(r[0], r[4]) for r in op.Matcher(KNOWN).of([t.encode() for t in texts])} == {(licence, True)}


@pytest.mark.parametrize("licence", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"])
def test_wrapped_headers_over_code_are_named(licence):
    code = "\nimport os\n\n" + "def function(argument):\n    return argument + 1\n" * 40
    texts = [f"/*\n{commented('Copyright 2020 Somebody' + chr(10) + header(licence), mark, width)}\n*/{code}" for mark in ("# ", "// ", " * ", "") for width in (50, 78)]
    assert {(r[0], r[4]) for r in op.Matcher(KNOWN).of([t.encode() for t in texts])} == {(licence, False)}


def test_every_template_names_its_own_licence():
    matcher = op.Matcher(KNOWN)
    assert [(k, matcher.of([t.encode()])[0][0]) for k, texts in KNOWN.items() for t in texts if matcher.of([t.encode()])[0][0] != k] == []


def test_long_texts_are_read_whole(spark):
    rng = random.Random(2)
    long = prose(rng, 200_000) + "\n" + MIT + "\n" + prose(rng, 1000)
    rows = [(1, "a", long), (2, "b", "\n" * 50_000 + GPL), (3, "c", "license " * 50_000)]
    assert got(op.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"))) == brute(rows)


def test_no_files_no_templates_and_too_many(spark, monkeypatch):
    files = spark.createDataFrame(ROWS, "doc_id long, path string, text string")
    assert op.scan(files.limit(0)).count() == 0 and {r.licence for r in op.scan(files, {}).collect()} == {None}
    for limit in ("MOST_BYTES", "MOST_CELLS"):
        with monkeypatch.context() as m, pytest.raises(ValueError):
            m.setattr(op, limit, 10)
            op.scan(files)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(r.doc_id, "/".join((r.source or "_", r.lang or "_", str(r.doc_id // 100), str(r.doc_id))), r.text) for r in docs]
    assert got(op6_license_scan(spark, sf_dir)) == brute(rows)
