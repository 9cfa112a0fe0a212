"""Polish word forms made by rule: endings of a few declensions and one conjugation, and roots from the language of statutes.

The list is the library's own and is what the analyser learns from (``operators.analysis``); callers may learn from a longer one.
"""

from __future__ import annotations

from collections.abc import Iterator

#: For each class the lemma's ending, the endings of its forms, and roots.
CLASSES: tuple[tuple[str, str, str], ...] = (
    ("a", "a y ie ę ą o - om ami ach", "ustaw spraw nazw zmian stron cen gmin norm reform rodzin podstaw opraw dopłat wypraw upraw drużyn"),
    ("ra", "ra ry rze rę rą ro r rom rami rach", "procedu kultu natu struktu prokuratu literatu dyktatu agentu"),
    ("cja", "cja cji cję cją cjo cje cjom cjami cjach", "regula institu organiza inspek funk informa dota konwen deklara opera korek produk sank redak frak"),
    ("ka", "ka ki ce kę ką ko k kom kami kach", "polity statysty prakty fabry klini techni grafi logi biblioty"),
    ("-", "- u owi em ie y ów om ami ach", "przepis zapis wpis program system problem zakres termin okres plan etap urlop postęp dostęp"),
    ("t", "t tu towi tem cie ty tów tom tami tach", "projek dokumen budże kosz komite paten transpor rapor apara pakie limi kredy"),
    ("r", "r ru rowi rem rze ry rów rom rami rach", "rejest sekto wymia obsza dokto inspekto dyrekto prokurato kurato rezerwua nadzo"),
    ("nie", "nie nia niu niem ń niom niami niach", "rozporządze orzecze postanowie zezwole świadcze ubezpiecze zobowiąza postępowa wykona działa zada zaświadcze uprawnie ogłosze zgłosze"),
    ("two", "two twa twu twem twie tw twom twami twach", "państ minister wojewódz przedsiębiors staros górnic rolnic budownic sądownic szkolnic leśnic dziedzic"),
    ("ość", "ość ości ością ościom ościami ościach", "działaln własn ludn odpowiedzialn wysok wart zdoln ważn jak jawn zgodn łączn należn płatn"),
    ("y", "y ego emu ym a ej ą e i ych ymi", "rządow budżetow podatkow zdrowotn publiczn karn cywiln administracyjn socjaln lokaln prawn narodow ustawow drogow celn skarbow finansow rodzinn mieszkaniow energetyczn społeczn"),
    ("ski", "ski skiego skiemu skim ska skiej ską skie scy skich skimi", "posel obywatel europej miej wiej mor lekar senator rycer ślą pomor gospodar"),
    ("ować", "ować uje ują ował owała owało owali owały ując owany owana owane", "regul kier plan organiz kontrol finans stos opodatk zawiadam wykon obowiąz pracow"),
)


def word_forms() -> Iterator[tuple[str, str]]:
    """Pairs ``(form, lemma)``, each once."""
    seen = set()
    for lemma, endings, roots in CLASSES:
        for root in roots.split():
            for ending in endings.split():
                pair = (root + ending.strip("-"), root + lemma.strip("-"))
                if pair not in seen:
                    seen.add(pair)
                    yield pair
