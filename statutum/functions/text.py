"""Text: titles in a form to compare, trigram similarity, stems of Polish legal language, highlights, mail text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import first_that_holds

# Word forms of three families that always have the same stem.
LEGAL_FORMS = {
    "ustawa": "ustawa ustawy ustawie ustawę ustawą ustaw ustawom ustawami ustawach",
    "projekt": "projekt projektu projekcie projekty projektów projektom projektami",
    "zmiana": "zmiana zmiany zmianie zmianę zmianą zmian zmianom zmianami zmianach",
}
# Words without meaning in a search.
STOP_WORDS = """
vol o.o. mgr godz zł www pl ul tel hab prof inż dr i u aby albo ale ani aż bardzo bez bo bowiem by byli bym był była było
były być będzie będą chce choć co coraz coś czy czyli często dla do gdy gdyby gdyż gdzie go ich im inne iż ja jak jakie jako
je jednak jednym jedynie jego jej jest jeszcze jeśli jeżeli już ją kiedy kilku kto która które którego której który których
którym którzy lat lecz lub ma mają mamy mi miał mimo mnie mogą może można mu musi na nad nam nas nawet nic nich nie niej nim
niż no nowe np nr o od ok on one oraz pan po pod ponad ponieważ poza przed przede przez przy raz razie roku również się sobie
sposób swoje są ta tak takich takie także tam te tego tej temu ten teraz też to trzeba tu tych tylko tym tys tzw tę w we wie
więc wszystko wśród właśnie z za zaś ze że żeby ii iii iv vi vii viii ix xi xii xiii xiv xv
""".split()
#: Endings of Polish inflection that the stemmer takes off, the longest that leaves ``LEFT`` letters.
ENDINGS = "iami iach iego iemu ami ach ego emu iom ich ych imi ymi owi iej iej ów om ej im ym ią ię ie ii ia iu a ą e ę i o u y".split()
LEFT = 3
#: Least similarity of a candidate, of one for review, and of one that is taken at once.
SIMILAR, REVIEW, TAKEN = 0.3, 0.35, 0.60


def _letters_without_marks() -> tuple[str, str]:
    """Characters that decompose into one letter and marks, and those letters; and the one Polish letter that does not decompose.

    Hangul syllables, which decompose into several letters, stay as they are.
    """
    found = {"ł": "l"}
    for code in range(0x80, 0x10000):
        if not 0xAC00 <= code < 0xE000:
            plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
            if len(plain) == 1 and plain != chr(code):
                found[chr(code)] = plain
    return "".join(found), "".join(found.values())


MARKED, PLAIN = _letters_without_marks()


def normalise_title(title: Column) -> Column:
    """Lower case, letters without any marks, other runs than letters and digits as one space, no space at the ends."""
    plain = F.regexp_replace(F.translate(F.lower(title), MARKED, PLAIN), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each with two spaces before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Share of trigrams that two texts have in common, 0 if neither has any."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def match_decision(score: Column) -> Column:
    """``fuzzy`` is pinned, ``review`` waits for a person, ``none`` is dropped."""
    return first_that_holds([(score >= TAKEN, "fuzzy"), (score >= REVIEW, "review")], "none")


def stem(word: Column) -> Column:
    """Stem of one lower-cased word: a fixed one for the three families, else without its ending.

    The table-driven stemmer that a search server would use is not available here; this one takes off the longest ending.
    """
    out, size = None, F.length(word)
    for root, forms in LEGAL_FORMS.items():
        fixed = word.isin(*dict.fromkeys([*forms.split(), root]))
        out = F.when(fixed, root) if out is None else out.when(fixed, root)
    for n in sorted({len(e) for e in ENDINGS}, reverse=True):
        ends = (size >= n + LEFT) & F.right(word, F.lit(n)).isin(*dict.fromkeys(e for e in ENDINGS if len(e) == n))
        out = out.when(ends, F.left(word, size - n))
    return out.otherwise(word)


def stems(text: Column) -> Column:
    """Stems of a text in their order, repeats kept, words without meaning left out."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))
    return F.transform(kept, stem)


def holds_all(wanted: Column, title: Column) -> Column:
    """Whether a title has every stem wanted. Wanting nothing matches nothing; null stems are not known yet and match nothing."""
    return F.coalesce((F.size(wanted) > 0) & (F.size(F.array_except(wanted, title)) == 0), F.lit(False))


def highlight(title: Column, wanted: Column) -> Column:
    """The title with every word whose stem is wanted between ``<em>`` and ``</em>``."""
    marked = F.regexp_replace(title, r"([\p{L}\p{N}]+)", "\u0001$1\u0001")
    piece = lambda p: F.when(p.rlike(r"\A[\p{L}\p{N}]+\z") & ~F.lower(p).isin(*STOP_WORDS) & F.array_contains(wanted, stem(F.lower(p))), F.concat(F.lit("<em>"), p, F.lit("</em>"))).otherwise(p)
    return F.array_join(F.transform(F.split(marked, "\u0001"), piece), "")


def normalise_interest(kind: Column, value: Column) -> Column:
    """The stored form of what a profile watches, null if the value is none of its kind."""
    raw = F.trim(value)
    upper, lower = F.upper(raw), F.lower(raw)
    keyword = F.regexp_replace(lower, r"\s+", " ")
    return first_that_holds(
        [
            ((kind == "pkd") & upper.rlike(r"\A\d{2}(\.\d)?(\d)?(\.[A-Z])?\z"), upper),
            ((kind == "region") & raw.rlike(r"\A(\d{2}|\d{4}|\d{7})\z"), raw),
            ((kind == "act") & upper.rlike(r"\A[A-Z]{2,4}/\d{4}/\d{1,6}\z"), upper),
            ((kind == "draft") & lower.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), lower),
            ((kind == "keyword") & (F.length(keyword) >= 3), keyword),
        ]
    )


def covers(kind: Column, wide: Column, narrow: Column) -> Column:
    """Whether an interest takes in another of its kind: codes by their beginnings, all else only itself."""
    pkd = (wide == narrow) | narrow.startswith(F.concat(wide, F.lit(".")))
    return F.when(kind == "pkd", pkd).when(kind == "region", narrow.startswith(wide)).otherwise(wide == narrow)


def plural_of_matters(n: Column) -> Column:
    """Polish counts in three forms: one, those that end in 2 to 4 but not in 12 to 14, and the others."""
    few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(n == 1, "sprawa").when(few, "sprawy").otherwise("spraw")


def escape_html(text: Column) -> Column:
    for found, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(found), F.lit(put))
    return text
