"""Text, dates and ids: golden values."""

import re
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from statutum.functions import dates, fetching, folds, ids, text, vocabulary
from statutum.functions.json_text import canonical


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


L = F.lit


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("Zażółć gęślą jaźń – ŁÓDŹ!", "zazolc gesla jazn lodz"),
        ("Café Ärzte à Łódź", "cafe arzte a lodz"),
        ("  (Ñandú), §7: čaj\u0301 n\u0303o ", "nandu 7 caj no"),
        ("Ωμέγα Ёлка ガ ộ", "ωμεγα елка カ o"),
        ("§ – …", ""),
        (" \n", ""),
    ],
)
def test_normalised_titles(spark, title, expected):
    assert one(spark, text.normalise_title(L(title))) == expected


def test_titles_equal_decomposition(spark):
    """Every character of the basic plane but Hangul, by the library's decomposition."""
    chars = [chr(c) for c in range(0x20, 0x10000) if not 0xAC00 <= c < 0xE000 and unicodedata.name(chr(c), "")]
    rows = spark.createDataFrame([(c, f"a{c}b") for c in chars], "c string, t string").select("c", F.regexp_replace(F.translate("t", text.MARKED, text.PLAIN), r"\p{Mn}+", "").alias("x")).collect()
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn").replace("ł", "l")
    wrong = [r.c for r in rows if r.x != plain(f"a{r.c}b")]
    assert len(wrong) <= 0.002 * len(chars)  # what decomposes into several letters, and marks newer than one of the two tables


STEM = rf"\A(.{{3,}}?)(?:{'|'.join(text.ENDINGS)})\Z"


def test_stems_take_off_the_longest_ending(spark):
    words = [f"{a}{b}" for a in ("", "k", "ko", "kot", "drzew", "łódk") for b in ["", *text.ENDINGS, "iamix", "ówów"]] + ["ustawach", "zmianą", "projekt", "𝄞𝄞𝄞ami"]
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()}
    families = {f: root for root, forms in text.LEGAL_FORMS.items() for f in [*forms.split(), root]}
    assert got == {w: families.get(w) or re.sub(STEM, r"\1", w, flags=re.S) for w in words}


def test_running_folds(spark):
    items = lambda n: F.sequence(L(1), L(n)) if n else F.array().cast("array<int>")
    for n in (0, 1, 63, 64, 65, 1000, 5000):
        got = one(spark, folds.running(items(n), L(0), lambda s, x: s + x, lambda s, x: F.struct(x.alias("x"), s.alias("before")), "struct<x:int,before:int>"))
        assert [(r.x, r.before) for r in got] == [(x, x * (x - 1) // 2) for x in range(1, n + 1)]


def test_trigram_similarity(spark):
    assert one(spark, text.trigram_similarity(text.trigrams(L("word")), text.trigrams(L("two words")))) == pytest.approx(4 / 11)
    assert one(spark, text.trigram_similarity(text.trigrams(L("")), text.trigrams(L(None)))) == 0.0


def test_stems(spark):
    s = lambda x: one(spark, text.stems(L(x)))
    assert s("ustawy, ustaw; ustawami") == ["ustawa"] * 3 and s("projekcie projekty") == ["projekt"] * 2 and s("zmiana zmianie") == ["zmiana"] * 2
    assert s("o w z na") == [] and s("o w na nie") == []
    for a, b in (("uchwała", "uchwały"), ("przepis", "przepisów"), ("energia", "energii"), ("cena", "cenach"), ("prawo budowlane", "prawa budowlanego")):
        assert s(a) == s(b) != []


def test_holding_all_stems(spark):
    a = lambda *x: F.array(*map(L, x)).cast("array<string>")
    assert one(spark, text.holds_all(a("x"), a("x", "y"))) is True
    assert one(spark, text.holds_all(a(), a("x"))) is False and one(spark, text.holds_all(L(None).cast("array<string>"), a("x"))) is False
    assert one(spark, text.holds_all(a("x"), a())) is False


@pytest.mark.parametrize(
    ("kind", "value", "stored"),
    [
        ("pkd", " 62.01.z ", "62.01.Z"), ("region", " 1465 ", "1465"), ("act", "du/2024/1222", "DU/2024/1222"), ("keyword", "  Prawo   Budowlane ", "prawo budowlane"), ("keyword", "od", None), ("pkd", "J", None), ("pkd", "6", None),
        ("pkd", "62,01", None), ("pkd", "62.01.ZZ", None), ("region", "Warszawa", None), ("region", "146", None), ("region", "14650", None), ("act", "ustawa o VAT", None), ("draft", "UX17", None), ("keyword", None, None), ("other", "x", None),
    ],
)
def test_interests(spark, kind, value, stored):
    assert one(spark, text.normalise_interest(L(kind), L(value).cast("string"))) == stored


def test_coverage(spark):
    c = lambda k, a, b: one(spark, text.covers(L(k), L(a), L(b)))
    assert c("pkd", "62", "62.01") and c("pkd", "62", "62.01.Z") and not c("pkd", "62.0", "62.01")
    assert c("region", "14", "1465") and c("region", "14", "1465011") and not c("region", "14", "02")
    assert c("keyword", "a", "a") and not c("keyword", "a", "ab")


def test_plural(spark):
    got = [one(spark, text.plural_of_matters(L(n))) for n in (1, 2, 4, 5, 12, 13, 22, 25)]
    assert got == ["sprawa", "sprawy", "sprawy", "spraw", "spraw", "spraw", "sprawy", "spraw"]


def test_html_is_escaped(spark):
    assert one(spark, text.escape_html(L('<a href="x">&amp;'))) == "&lt;a href=&quot;x&quot;&gt;&amp;amp;"


def test_highlight(spark):
    assert one(spark, text.highlight(L("Ustawy o cenach, energii!"), text.stems(L("ustawa cena")))) == "<em>Ustawy</em> o <em>cenach</em>, energii!"


def closed(spark, mode, now, since, hour=None, weekday=None):
    ts = lambda x: L(x).cast("timestamp")
    return one(spark, dates.window_closed(L(mode), L("Europe/Warsaw"), L(hour).cast("int"), L(weekday).cast("int"), ts(now), ts(since)))


def test_digest_windows(spark):
    assert closed(spark, "immediate", "2026-08-22 05:30:00", "2026-08-22 05:29:00") is True
    assert closed(spark, "daily", "2026-08-22 05:30:00", "2026-08-21 20:00:00", 8) is False
    assert closed(spark, "daily", "2026-08-22 06:30:00", "2026-08-21 20:00:00", 8) is True
    assert closed(spark, "hourly", "2026-08-22 10:05:00", "2026-08-22 09:50:00") is True
    assert closed(spark, "hourly", "2026-08-22 10:40:00", "2026-08-22 10:05:00") is False
    assert closed(spark, "weekly", "2026-08-19 20:00:00", "2026-08-13 08:00:00", 9, 4) is False
    assert closed(spark, "weekly", "2026-08-20 07:30:00", "2026-08-13 08:00:00", 9, 4) is True
    assert closed(spark, "daily", "2027-03-28 02:00:00", "2027-03-27 12:00:00", 2) is True  # an hour that the clock skips


def test_quiet_hours(spark):
    q = lambda at, a=22, b=7: one(spark, dates.is_quiet(L(a).cast("int"), L(b).cast("int"), L("Europe/Warsaw"), L(f"2026-08-22 {at}:00").cast("timestamp")))
    assert q("21:30") and q("03:00") and not q("09:00") and not q("03:00", None, None)
    assert q("10:00", 11, 13) and not q("11:00", 11, 13)


def test_tolerant_dates(spark):
    got = [one(spark, dates.tolerant_date(L(x))) for x in ("2026-04-09", "09-04-2026", "2026-04-09 15:26", "2026-04-09T10:00:00", "31-02-2026", "2026-13-01", "soon", "")]
    assert got == [date(2026, 4, 9)] * 4 + [None] * 4
    assert one(spark, dates.minute_timestamp(L("2026-04-09 15:26"))) == datetime(2026, 4, 9, 15, 26)
    assert one(spark, dates.tolerant_date(L(None).cast("string"))) is None


def test_small_parsers(spark):
    assert one(spark, dates.roman_term(L(" x "))) == 10 and one(spark, dates.roman_term(L("XXI"))) is None
    assert one(spark, dates.comma_list(L(" a, ,b ,"))) == ["a", "b"] and one(spark, dates.comma_list(L(None).cast("string"))) == []
    assert one(spark, dates.trailing_number(L("kryteriów: 345 "))) == 345 and one(spark, dates.trailing_number(L("none"))) == 0
    assert one(spark, dates.page_count(L(345), L(100))) == 4 and one(spark, dates.page_count(L(0), L(100))) == 0
    low, high = dates.backoff_bounds(L(1))
    assert (one(spark, low), one(spark, high)) == (5.0, 10.0) and one(spark, dates.backoff_bounds(L(30))[1]) == 3600.0


def test_ids(spark):
    assert one(spark, ids.print_address(L(10), L("31"))) == "term10/print/31" and one(spark, ids.print_address(L(None).cast("int"), L("31"))) is None
    assert one(spark, ids.project_address("ustawy", L("1"), L("2"), register=True)) == "projekt/ustawy/1/katalog/2/rejestr"
    assert one(spark, ids.is_eli(L("DU/2026/1"))) and not one(spark, ids.is_eli(L("DU/2026/1 "))) and not one(spark, ids.is_eli(L("DU/2026/1\n")))
    assert one(spark, ids.publisher_of(L("MP/2020/5"))) == "MP"
    assert one(spark, ids.blob_key(ids.content_hash(L("")))) == "e3/b0/e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, ids.event_key(L("draft"), L("7"), L(None).cast("string"))) == "draft:7@unknown" and one(spark, ids.event_key(L("act"), L("7"), L("x"))) == "act:7"
    assert one(spark, ids.email_address(L(" A@B.pl "))) == "a@b.pl"


def test_vocabulary(spark):
    assert one(spark, vocabulary.initiator_of(L("Przedstawiony przez Prezydium Sejmu projekt"))) == "prezydium_sejmu"
    assert one(spark, vocabulary.initiator_of(L("rządowy projekt"))) == "nieznany"  # case counts
    assert [one(spark, vocabulary.stage_of(L("Reading"), L(f"{n} czytanie w komisjach"))) for n in ("I", "II", "III", "IV")] == ["i_czytanie", "ii_czytanie", "iii_czytanie", None]
    assert [one(spark, vocabulary.audit_outcome(L(s))) for s in (200, 302, 401, 403, 404, 500)] == ["succeeded", "succeeded", "denied", "denied", "rejected", "failed"]
    assert [one(spark, vocabulary.government_kind(L(x))) for x in ("projekt/ustawa/1", "projekt/ustawa/1/rejestr", "projekt/ustawa/1/katalog/2", "projekt/ustawa/1/katalog/2/rejestr", "x")] == ["rcl-project", "rcl-change-register", "rcl-catalog", "rcl-catalog-change-register", "unknown"]


def test_canonical_json(spark):
    assert one(spark, canonical(L('{"b": [2, 1], "a": {"z": 1, "y": "ż"}}'))) == '{"a":{"y":"ż","z":1},"b":[2,1]}'
    assert one(spark, canonical(L("no"))) is None and one(spark, canonical(L(None).cast("string"))) is None


def test_fetches(spark):
    o = lambda s, a=True, r=None: one(spark, fetching.fetch_outcome(L(s).cast("int"), L(a).cast("boolean"), L(r).cast("boolean")))
    assert [o(200), o(304), o(404), o(None), o(200, False), o(200, True, True), o(404, True, True)] == ["fetched", "not_modified", "failed", "failed", "refused", "refused", "failed"]
    r = lambda s, n: one(spark, fetching.may_retry(L(s).cast("int"), L(n)))
    assert [r(429, 1), r(503, 3), r(503, 4), r(404, 1), r(None, 1)] == [True, True, False, False, False]
    assert one(spark, fetching.requests_per_second(L(None).cast("double"), L(2.0))) == 2.0 and one(spark, fetching.wait_before_retry(L(3))) == 4.0
