"""Secret scan: patterns, and a randomness test battery with length-aware false-discovery control. DataFrame functions alone.

Base spans, per kind the leftmost non-overlapping matches, kept if long enough: ``assign`` (a secret-like name, a sign, a
value of 12 characters or more), ``access`` (AKIA and capitals or digits, 18 or more) and ``hex`` (16 or more).

The battery looks at every other run of 20 or more base64-like characters that mixes letters and digits. The narrowest
encoding that explains the run is inferred (base 16, 32 or 36 of either case, 62 or 64). It takes the chi-squared statistic of
the character counts against an even alphabet, the number of runs of characters of one class (digits, capitals, small letters, signs)
and the serial correlation of neighbours, and joins their tails by Fisher's method into one score of randomness, which is even between
0 and 1, about, for characters drawn by chance, and near 0 for words.

What is reported as ``random`` is controlled: the hypothesis to be rejected is that a run is an ordinary name. Ordinary names are made of the
corpus itself: the words of every text, in its order, joined in groups as names are written (with underscores, in camel case,
in small letters or capitals, a number behind one of the words). Their scores, counted by encoding, band of length and bin, give each run's p-value, the
share of ordinary names of its encoding and band that score as high (adding one). Every group of words of the whole corpus is made a name and counts (a caller may set
``FLOOR``, for which one in 16 is drawn first, then one in 4, then all, until each encoding and band has so many). Where these are fewer than ``ENOUGH``, as of encodings that words hardly ever have, all encodings of the band count, then all
bands, each name for as many as it was drawn from. In each band of lengths, Benjamini and Hochberg's step-up procedure at level ``ALPHA`` over all runs of
the corpus then reports runs, so that of the reported ones a share of ``ALPHA`` is expected to be ordinary names. Short runs are so
judged by what short names look like. Without words nothing is reported beside base spans. Counts by encoding, band and bin, a table of
bounded size, are all that reaches the driver.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Equal rows give equal rows, null and repeated ids too; other columns
are ignored. An empty table gives no rows. The work on a text grows with its length times the square root of its number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import bound, running
from .common import materialize

#: Kinds in their order, with their patterns (matches are marked with $0).
KINDS = ("assign", "access", "hex", "random")
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = f"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?({VALUE}+)"
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_-]{20,}={0,2}"
ASSIGN_VALUE = 12
#: Level of the procedure; first lengths of the bands; bins for a halving of a score, and of them all; ordinary names that suffice.
ALPHA, BANDS, BINS_PER_HALVING, BINS, ENOUGH = 0.05, (20, 24, 32, 40, 64, 128), 4, 400, 400
#: Words in an ordinary name, by a hash of the text. Where a number of names (``FLOOR``) is set that suffices, one group of words in so many is made a name, round by round.
WORDS_IN_NAME, ROUNDS, FLOOR = (4, 5, 7, 10, 16, 30), (16, 4, 1), None

#: A private-use character marks matches; where a text has it, a character that no pattern takes stands in.
MARK, STAND_IN = "\ue000", "#"

ALPHABETS = {
    16: "0123456789ABCDEF",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    36: "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def matches(text: Column, pattern: str, keep=None) -> Column:
    """``array<struct<start, end, found>>`` of the leftmost non-overlapping matches of a pattern, for which ``keep`` holds.

    Matches are put between marks; the pieces between marks are then alternately text and match, and the lengths of the
    pieces before give the offsets.
    """
    kind = "struct<start:int,end:int,found:string>"

    def placed(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"))
        step = lambda s, x: F.struct((s["i"] + 1).alias("i"), (s["at"] + F.length(x)).alias("at"))
        emit = lambda s, x: F.struct(s["at"].alias("start"), (s["at"] + F.length(x)).alias("end"), F.when(s["i"] % 2 == 1, x).alias("found"))
        return F.filter(running(pieces, start, step, emit, kind), lambda m: m["found"].isNotNull() & (F.lit(True) if keep is None else keep(m["found"])))

    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    return bound(pieces, lambda p: F.when(F.size(p) > 1, placed(p)).otherwise(F.array().cast(f"array<{kind}>")))


def apart(runs: Column, base: Column) -> Column:
    """The runs that overlap no base span: both in order of starts, once forward with the last end and once backward with the next start."""
    kind = "struct<start:int,own:int,end:int,found:string,hit:boolean>"
    row = lambda m, own, found: F.struct(m["start"].alias("start"), F.lit(own).alias("own"), m["end"].alias("end"), found.alias("found"), F.lit(False).alias("hit"))
    both = F.sort_array(F.concat(F.transform(base, lambda b: row(b, 0, F.lit(None).cast("string"))), F.transform(runs, lambda m: row(m, 1, m["found"]))))
    marked = lambda x, hit: F.struct(x["start"], x["own"], x["end"], x["found"], hit.alias("hit"))
    ahead = running(both, F.lit(-1), lambda s, x: F.when(x["own"] == 0, F.greatest(s, x["end"])).otherwise(s), lambda s, x: marked(x, s > x["start"]), kind)
    back = running(F.reverse(ahead), F.lit((1 << 31) - 1), lambda s, x: F.when(x["own"] == 0, F.least(s, x["start"])).otherwise(s), lambda s, x: marked(x, x["hit"] | (s < x["end"])), kind)
    free = F.transform(F.filter(F.reverse(back), lambda x: (x["own"] == 1) & ~x["hit"]), lambda x: F.struct(x["start"], x["end"], x["found"]))
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(free)


def upper_tail(z: Column) -> Column:
    """Chance that a normal variable exceeds z, by a logistic approximation (error under 2e-4); z is worked out once."""
    return bound(z, lambda v: 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * v + 0.070565676 * v * v * v))))


def scored(token: Column) -> Column:
    """``struct<base, score>``: the inferred encoding of a run and its randomness; null if it does not mix letters and digits."""
    body = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    return bound(body, lambda b: F.when(b.rlike("[0-9]") & b.rlike("[A-Za-z]"), bound(encoded(b), lambda e: F.struct(e["base"].alias("base"), evenness(e).alias("score")))))


def randomness(token: Column) -> Column:
    """The score of a run: even between 0 and 1, about, for characters drawn evenly from its inferred alphabet; null if none fits."""
    return scored(token)["score"]


def encoded(body: Column) -> Column:
    """``struct<base, body, alphabet>``: the narrowest encoding of a run; encodings of one case have the run in capitals."""
    kinds = {"^(?:[0-9a-f]+|[0-9A-F]+)$": 16, "^(?:[A-Z2-7]+|[a-z2-7]+)$": 32, "^(?:[A-Z0-9]+|[a-z0-9]+)$": 36, "^[A-Za-z0-9]+$": 62, "": 64}
    out = None
    for pattern, base in kinds.items():
        kind = F.struct(F.lit(base).alias("base"), (F.upper(body) if base <= 36 else body).alias("body"), F.lit(ALPHABETS[base]).alias("alphabet"))
        out = F.when(body.rlike(pattern), kind) if out is None else out.when(body.rlike(pattern), kind) if pattern else out.otherwise(kind)
    return out


#: Characters of each class, by what stands for them; shares of the classes by encoding.
CLASSES = {"d": "0123456789", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "l": "abcdefghijklmnopqrstuvwxyz", "s": "+/"}
SHARES = {base: [sum(c in of for c in alphabet) / base for of in CLASSES.values()] for base, alphabet in ALPHABETS.items()}


def evenness(run: Column) -> Column:
    """The battery's joint tail for an encoded run.

    Class changes of n characters drawn evenly have mean ``(n - 1)(1 - q)`` and variance ``(n - 1) q (1 - q) + 2 (n - 2)(r - q q)``, q and r
    being the sums of squares and cubes of the classes' shares.
    """
    body, alphabet = run["body"], run["alphabet"]
    n, k = F.length(body).cast("double"), run["base"].cast("double")
    squares = F.aggregate(F.array_distinct(F.split(body, "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
    chi, free = k / n * squares - n, k - 1
    spread = 2 / (9 * free)
    p_chi = upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    classes = F.translate(body, "".join(CLASSES.values()), "".join(k * len(v) for k, v in CLASSES.items()))
    changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double") - 1
    moment = lambda power: F.element_at(F.create_map(*(F.lit(x) for base, shares in SHARES.items() for x in (base, sum(p**power for p in shares)))), run["base"])
    q, r = moment(2), moment(3)
    p_runs = 2 * upper_tail(F.abs(changes - (n - 1) * (1 - q)) / F.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (r - q * q) + F.lit(1e-9)))
    middle, variance = (k - 1) / 2, (k * k - 1) / 12
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"))  # neighbours' products about the middle; the first has none
    step = lambda a, c: bound(F.instr(alphabet, c).cast("double") - 1 - middle, lambda x: F.struct(x.alias("last"), (a["sum"] + a["last"] * x).alias("sum")))
    serial = F.aggregate(F.split(body, ""), start, step, lambda a: a["sum"])
    p_serial = 2 * upper_tail(F.abs(serial / variance / F.sqrt(n - 1)))
    floor = F.lit(1e-100)
    half = -(F.log(F.greatest(p_chi, floor)) + F.log(F.greatest(F.least(p_runs, F.lit(1.0)), floor)) + F.log(F.greatest(F.least(p_serial, F.lit(1.0)), floor)))
    return bound(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))


def band_of(size: Column) -> Column:
    return sum((F.when(size >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))


def bin_of(score: Column) -> Column:
    """Bins of scores: 0 holds the most random."""
    return F.least(F.lit(BINS), F.floor(-F.log2(F.greatest(score, F.lit(1e-300))) * BINS_PER_HALVING).cast("int"))


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, runs``: base spans by start and kind, and runs with encoding, band and bin."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, STAND_IN)
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN.replace("(?i)", "(?i)^") + "$", 1)) >= ASSIGN_VALUE
    named = lambda found, kind: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    rows = docs.select("doc_id", text.alias("t"))
    rows = rows.select("doc_id", matches(F.col("t"), ASSIGN, long_enough).alias("assign"), matches(F.col("t"), ACCESS).alias("access"), matches(F.col("t"), HEX).alias("hex"), matches(F.col("t"), RUN).alias("run"))
    base = F.sort_array(F.concat(named(F.col("assign"), 0), named(F.col("access"), 1), named(F.col("hex"), 2)))
    rows = rows.select("doc_id", base.alias("base"), "run")
    rows = rows.withColumn("run", apart(F.col("run"), F.col("base")))
    judged = lambda m: bound(scored(m["found"]), lambda x: F.struct(m["start"].alias("start"), m["end"].alias("end"), x["base"].alias("base"), band_of(m["end"] - m["start"]).alias("band"), bin_of(x["score"]).alias("bin")))
    return rows.select("doc_id", "base", F.filter(F.transform("run", judged), lambda r: r["bin"].isNotNull()).alias("runs"))


def ordinary_names(docs: DataFrame, share: int = 1, before: int | None = None) -> DataFrame:
    """``name``: names made of the words of every text, in groups of one size for a text, of which one in ``share`` is written in one of four ways.

    Those that were drawn when the share was ``before`` are left out.
    """
    bare = F.translate("text", "\n\r\t\"'().,;:!?", "   ")  # marks beside words go
    words = docs.where("text <> ''").select(F.split(bare, " ").alias("w"), F.xxhash64("text").alias("t"))
    size = F.element_at(F.array(*map(F.lit, WORDS_IN_NAME)), F.pmod("t", F.lit(len(WORDS_IN_NAME))).cast("int") + 1)
    words = words.withColumn("size", size)
    chosen = lambda k: bound(F.xxhash64("t", k), lambda h: (F.pmod(h, F.lit(share)) == 0) & (F.lit(True) if before is None else F.pmod(h, F.lit(before)) != 0))
    drawn_groups = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / F.col("size")).cast("int"))
    drawn_groups = drawn_groups if share == 1 and before is None else F.filter(drawn_groups, chosen)
    groups = words.select(F.explode(F.transform(drawn_groups, lambda k: F.slice("w", k * F.col("size") + 1, F.col("size")))).alias("g"))
    groups = groups.select(F.filter("g", lambda w: w.rlike("^[A-Za-z]{2,15}$")).alias("g")).where(F.size("g") > 0)
    groups = groups.withColumn("h", F.xxhash64("g"))
    drawn = lambda shift, n: F.pmod(F.shiftright("h", shift), F.lit(n)).cast("int")
    number = F.left(F.lpad(drawn(8, 1000).cast("string"), F.lit(3), F.lit("0")), drawn(24, 3) + 1)
    place = F.pmod(F.shiftright("h", 32), F.size("g")).cast("int") + 2  # behind some word
    groups = groups.withColumn("g", F.array_insert("g", place, number))
    joined = F.lower(F.array_join("g", ""))
    style = drawn(0, 4)
    name = F.when(style == 0, F.lower(F.array_join("g", "_"))).when(style == 1, F.array_join(F.transform("g", lambda w: F.initcap(w)), "")).when(style == 2, joined).otherwise(F.upper(joined))
    return groups.select(name.alias("name")).where(F.length("name") >= BANDS[0])


def calibration(docs: DataFrame, cells: set[tuple[int, int]]) -> tuple[dict[tuple[int, int], dict[int, int]], dict[tuple[int, int], int]]:
    """Ordinary names by encoding and band, then by bin, and the share that each encoding and band was drawn with, for runs in ``cells``."""
    ordinary: dict[tuple[int, int], dict[int, int]] = {}
    every = {(base, band) for base in ALPHABETS for band in range(len(BANDS))}
    shares: dict[tuple[int, int], int] = {}
    held = lambda cell: sum(ordinary.get(cell, {}).values())
    rounds = ROUNDS if FLOOR else (1,)
    for k, share in enumerate(rounds):
        thin = {cell for cell in every if not FLOOR or held(cell) < FLOOR}
        if not thin & cells:
            break
        names = ordinary_names(docs, share, rounds[k - 1] if k else None).withColumn("band", band_of(F.length("name")))
        place = lambda base: base * len(BANDS) + F.col("band")
        body = F.translate("name", "_", "/")
        wanted = names.where(place(encoded(body)["base"]).isin(sorted(base * len(BANDS) + band for base, band in thin))) if len(thin) < len(every) else names
        for cell, bins in counted(wanted.select(scored(F.col("name")).alias("x"), "band").select("x.base", "band", bin_of(F.col("x.score")).alias("bin")).where("base is not null")).items():
            mine = ordinary.setdefault(cell, {})
            for at, n in bins.items():
                mine[at] = mine.get(at, 0) + n
        shares |= dict.fromkeys(thin, share)
    return ordinary, shares


def counted(runs: DataFrame) -> dict[tuple[int, int], dict[int, int]]:
    """Runs ``(base, band, bin)`` by encoding and band, then by bin; at most ``len(ALPHABETS) * len(BANDS) * (BINS + 1)`` rows."""
    out: dict[tuple[int, int], dict[int, int]] = {}
    for row in runs.groupBy("base", "band", "bin").count().collect():
        out.setdefault((row["base"], row["band"]), {})[row["bin"]] = row["count"]
    return out


def reported_bins(runs: dict[tuple[int, int], dict[int, int]], ordinary: dict[tuple[int, int], dict[int, int]], shares: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """For each encoding and band of runs the last bin whose runs are reported; those of which none is are left out.

    ``shares``: names of an encoding and band stand for so many each (1).
    """
    shares = shares or {}

    def pooled(cells: list[tuple[int, int]]) -> tuple[int, dict[int, int]]:
        """What one more name would stand for at most, and the weights of names by bin, in units of the smallest share."""
        least = min((shares.get(c, 1) for c in cells), default=1)
        total: dict[int, int] = {}
        for cell in cells:
            for place, n in ordinary[cell].items():
                total[place] = total.get(place, 0) + n * shares.get(cell, 1) // least
        return max((shares.get(c, 1) for c in cells), default=1) // least, total

    def tails(base: int, band: int) -> dict[int, float]:
        wider = [[c for c in ordinary if keep(c)] for keep in (lambda c: c == (base, band), lambda c: c[1] == band, lambda c: True)]
        more, null = pooled(next((cells for cells in wider if sum(sum(ordinary[c].values()) for c in cells) >= ENOUGH), wider[-1]))
        total, upto, out = sum(null.values()), 0, {}
        order = sorted(null)
        for place in sorted(runs[base, band]):
            while order and order[0] <= place:
                upto += null[order.pop(0)]
            out[place] = (more + upto) / (more + total)
        return out

    out: dict[tuple[int, int], int] = {}
    for band in {band for _, band in runs}:
        of = {cell: tails(*cell) for cell in runs if cell[1] == band}
        every = sorted((p, n) for cell, p_of in of.items() for place, n in runs[cell].items() for p in [p_of[place]])
        total, upto, level = sum(n for _, n in every), 0, -1.0
        for i, (p, n) in enumerate(every):
            upto += n
            if (i + 1 == len(every) or every[i + 1][0] > p) and p <= ALPHA * upto / total:
                level = p
        for cell, p_of in of.items():
            places = [place for place, p in p_of.items() if p <= level]
            if places:
                out[cell] = max(places)
    return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` for every row of ``docs(doc_id, text)``: arrays of ``start, kind, end``, kinds by their number in KINDS."""
    found = materialize(found_spans(docs), "spans")
    runs = counted(found.select(F.explode("runs").alias("r")).select("r.base", "r.band", "r.bin"))
    reported = reported_bins(runs, *calibration(docs, set(runs))) if runs else {}
    last = F.create_map(*(F.lit(x) for (base, band), place in sorted(reported.items()) for x in (base * len(BANDS) + band, place))) if reported else F.create_map().cast("map<int,int>")
    known = lambda r: F.coalesce(r["bin"] <= F.try_element_at(last, r["base"] * len(BANDS) + r["band"]), F.lit(False))
    random = F.transform(F.filter("runs", known), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return found.select("doc_id", "base", F.sort_array(F.concat("base", random)).alias("spans"))


def joined(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")
