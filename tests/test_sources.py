"""Readers: registers as JSON and HTML, walks, the landed-files source."""

import json
import os
from datetime import date, datetime
from urllib.parse import quote

from pyspark.sql import functions as F

from statutum.sources import gazette, government, landing, parliament

PROCESS = {
    "number": "8842", "term": 10, "title": "Obywatelski projekt ustawy o latarniach", "documentTypeEnum": "BILL", "processStartDate": "2031-03-03", "closureDate": "2031-03-19", "passed": True, "ELI": "DU/2031/77",
    "stages": [
        {"date": "2031-03-03", "stageName": "Projekt wpłynął do Sejmu", "stageType": "Start", "children": [{"stageName": "x"}]},
        {"date": "2031-03-10", "stageName": "I czytanie na posiedzeniu Sejmu", "stageType": "SejmReading"},
        {"date": "2031-03-12", "stageName": "III czytanie na posiedzeniu Sejmu", "stageType": "SejmReading"},
        {"date": "2031-03-14", "stageName": "Coś", "stageType": "Other"},
        {"stageName": "Uchwalono", "stageType": "End"},
    ],
}


def documents(spark, *rows):
    return spark.createDataFrame([(a, p if isinstance(p, str) or p is None else json.dumps(p)) for a, p in rows], "external_id string, payload string")


def test_processes(spark):
    rows = documents(spark, ("term10/process/8842", PROCESS), ("x", PROCESS | {"documentTypeEnum": "CANDIDATE"}), ("y", "no json"), ("z", None))
    (p,) = parliament.processes(rows).collect()
    assert (p.address, p.initiator, p.outcome, p.closed_on, p.eli) == ("term10/print/8842", "obywatelski", "uchwalony", date(2031, 3, 19), "DU/2031/77")
    assert [(s.ordinal, s.stage) for s in p.stages] == [(0, "wplynal_do_sejmu"), (1, "i_czytanie"), (2, "iii_czytanie"), (3, None), (4, None)]
    open_ = parliament.processes(documents(spark, ("a", PROCESS | {"closureDate": None, "ELI": None}))).first()
    assert (open_.outcome, open_.closed_on, open_.eli) == (None, None, None)
    assert [tuple(r) for r in parliament.unmapped_stages(rows.limit(1)).collect()] == [("Other", 1)]


def test_addresses_are_classified(spark):
    rows = documents(
        spark, ("term10/print/61", {"title": "Druk", "documentDate": "2031-05-06"}), ("term10/club/KO", {"name": "Klub"}), ("term10/mp/1", {"firstLastName": "Ktoś"}),
        ("term10/proceeding/1/voting/2", {"description": "Głosowanie", "date": "2031-02-01T09:08:07"}), ("term10/proceeding/1", {"title": "Posiedzenie", "dates": ["2031-03-03"]}), ("term9/proceeding/2030-07-08", {"title": "P", "dates": ["2030-07-08"]}), ("term10/interpellation/7", {"title": "x"}), ("aterm10/print/1", {"title": "x"}),
    )
    got = {r.external_id: (r.kind, r.title, r.published_at) for r in parliament.classified(rows).collect()}
    assert got["term10/print/61"] == ("print", "Druk", datetime(2031, 5, 6))
    assert got["term10/proceeding/1/voting/2"] == ("voting", "Głosowanie", datetime(2031, 2, 1, 9, 8, 7))
    assert got["term9/proceeding/2030-07-08"][0] == "proceeding" and got["term10/mp/1"] == ("mp", "Ktoś", None)
    assert got["term10/interpellation/7"] == ("unknown", None, None) and got["aterm10/print/1"][0] == "unknown"


def test_acts(spark):
    act = {"ELI": "DU/2032/15", "title": "Ustawa", "type": " ", "promulgation": "2032-01-09", "entryIntoForce": "kiedyś", "prints": [{"term": 10, "number": "48"}, {"number": "1"}], "references": {"Akty zmienione": [{"id": "DU/2020/1", "date": "x"}, {"id": "bad"}]}}
    rows = documents(spark, ("DU/2032/15", act), ("DU/2026/1", act | {"ELI": "DU-2026-1"}), ("DU/2026/2", act | {"title": ""}))
    acts = gazette.parsed_acts(rows)
    (a,) = acts.collect()
    assert (a.act_type, a.announced_on, a.in_force_from, a.prints) == ("nieokreślony", date(2032, 1, 9), None, ["term10/print/48"])
    assert [tuple(r) for r in gazette.references(acts).collect()] == [("DU/2032/15", "Akty zmienione", "DU/2020/1")]
    assert [r.kind for r in gazette.classified(documents(spark, ("DU/2026/16", act), ("DU-2026-16", act))).orderBy("external_id").collect()] == ["unknown", "act"]


def test_search_pages(spark):
    pages = spark.createDataFrame([(1, json.dumps({"totalCount": 2, "items": [{"ELI": "DU/2026/1", "title": "a"}, {"ELI": "x"}]}))], "page_id int, body string")
    sound, warned = gazette.page_items(pages)
    assert [(r.external_id, r.items_served, r.total_count) for r in sound.collect()] == [("DU/2026/1", 2, 2)]
    assert [r.warning for r in warned.collect()] == ["MISSING_FIELD:/acts/items[].ELI (x)"]


def test_publishers_are_skipped_and_cursor_waits(spark):
    rows = spark.createDataFrame([("DU", "2024-05-01", True), ("MP", "2024-03-01", True), ("XX", None, False)], "publisher string, changed_at string, completed boolean")
    passes = gazette.publishers_to_read(rows, F.lit("2024-04-01"))
    assert {r.publisher: r.changed for r in passes.collect()} == {"DU": True, "MP": False, "XX": False}
    c = gazette.next_cursor(passes, F.lit("2024-04-10"), F.lit("2024-04-01"), F.lit("2024-05-02")).first()
    assert (c.published_through, c.last_change, c.source_unchanged) == ("2024-04-10", "2024-05-01", False)


def test_backfill_chunks_resume(spark):
    rows = spark.createDataFrame([(10, n) for n in range(1, 8)], "term int, number int")
    first = parliament.backfill_chunk(rows, "term", "number", F.lit(None), 5)
    assert [r.number for r in first.orderBy("number").collect()] == [1, 2, 3, 4, 5]
    assert parliament.chunk_cursor(first, "term", "number").first().position == {"last": "5"}
    assert parliament.chunk_cursor(parliament.backfill_chunk(rows, "term", "number", F.lit(5), 5), "term", "number").first().position == {"last": "7", "done": "true"}


CARD = """<html><body><div class="projectTitle"><span class="rcl-title">O <b>latarniach</b> morskich</span></div>
<div class="info"><div class="row"><div class="col-xs-4">Data utworzenia:</div><div class="col-xs-6">17-11-2033</div></div>
<div class="row"><div class="col-xs-4">Kadencja sejmu:</div><div class="col-xs-6"> XIV </div></div>
<div class="row"><div class="col-xs-4">Numer z wykazu:</div><div class="col-xs-6"><a href="https://p.example/plan">LM204</a>, </div></div></div>
<a href="/projekt/rejestr/projekt/640">rejestr</a>
<ul class="cbp_tmtimeline"><li id="31"><div class="cbp_tmlabel_notstart"><div>4. Objazd wybrzeża</div></div></li>
<li id="32"><div class="cbp_tmlabel"><a href="/projekt/640/katalog/32">5. Pomiar światła</a><div class="small2">Data ostatniej modyfikacji: 30-12-2033</div></div></li>
<li><div class="cbp_tmlabel_active"><a href="/projekt/640/katalog/33">Wystawa modeli</a></div></li><li><div>bez numeru</div></li></ul></body></html>"""


def test_project_cards(spark):
    pages = spark.createDataFrame([("a", CARD), ("b", "<p>none"), ("c", None), ("d", "")], "page string, html string")
    (c,) = government.project_cards(pages).collect()
    assert (c.page, c.project_id, c.title, c.created_on, c.term, c.register_numbers, c.programme_url) == ("a", "640", "O latarniach morskich", date(2033, 11, 17), 14, ["LM204"], "https://p.example/plan")
    assert [(s.catalog_id, s.ordinal, s.name, s.state, s.visitable) for s in c.stages] == [("31", 4, "Objazd wybrzeża", "not_started", False), ("32", 5, "Pomiar światła", "done", True), ("33", None, "Wystawa modeli", "current", True)]
    assert c.stages[1].last_modified_on == date(2033, 12, 30)


REGISTER = """<div>Rejestr zdarzeń dla katalogu "Wystawa modeli" w projekcie "O "wielkich" boi" <a href="/projekt/rejestr/projekt/812">wyżej</a></div>
<table><tbody><tr><td>2033-02-11 07:48</td><td>Latarnik</td><td>Zmieniono atrybut projektu nazwa etapu na:  5. Pomiar światła</td></tr>
<tr><td>2033-02-11 19:03</td><td>Latarnik</td><td>Zmieniono atrybut katalogu opis na:</td></tr>
<tr><td>2033-06-01 22:59</td><td>Bosman</td><td>Dodano katalog Szkice boi <a href="/projekt/812/katalog/4405">(rejestr)</a></td></tr>
<tr><td>wczoraj</td><td>Bosman</td><td>Dodano dokument rysunek masztu.pdf</td></tr><tr><td></td><td></td><td>Stworzono projekt</td></tr><tr><td>pusto</td></tr></tbody></table>"""


def test_registers(spark):
    pages = spark.createDataFrame([("r", REGISTER)], "page string, html string")
    rows = government.register_changes(pages).orderBy("place").collect()
    assert [r.kind for r in rows] == ["attribute_changed", "attribute_changed", "catalog_added", "document_added", "project_created"]
    assert (rows[0].attribute, rows[0].new_value, rows[0].occurred_at) == ("nazwa etapu", "5. Pomiar światła", datetime(2033, 2, 11, 7, 48))
    assert rows[1].new_value == "" and (rows[2].catalog_name, rows[2].catalog_id) == ("Szkice boi", "4405") and rows[3].occurred_at is None
    changes = government.register_changes(pages)
    assert [x(changes).count() for x in (government.stage_transitions, government.child_catalogs, government.documents_filed)] == [1, 1, 1]
    s = government.register_subject(pages).first()
    assert (s.scope, s.name, s.parent_scope, s.parent_name, s.parent_id) == ("catalog", "Wystawa modeli", "project", 'O "wielkich" boi', "812")


LISTING = """<div id="list"><div class="col-sm-8">Znaleziono latarni: 58</div></div><div id="lista"><table id="table"><tbody>
<tr><td><a href="/projekt/903">Maszt północny</a></td><td>Port</td><td>LM9</td><td>06-10-2033</td><td>23-12-2033</td></tr><tr><td>sam tekst</td></tr>
<tr><td><a href="/projekt/907">Maszt południowy</a></td><td>Zatoka</td><td></td><td></td><td></td></tr></tbody></table></div>"""


def test_listings(spark):
    rows = government.listing_entries(spark.createDataFrame([(LISTING,)], "html string")).orderBy("place").collect()
    assert [(r.project_id, r.title, r.register_number, r.modified_on, r.total_count) for r in rows] == [("903", "Maszt północny", "LM9", date(2033, 12, 23), 58), ("907", "Maszt południowy", None, None, 58)]


def test_walk_stops_after_the_page_with_an_older_entry(spark):
    rows = [("u", 1, 1, "a", date(2026, 8, 5)), ("u", 1, 2, "b", None), ("u", 2, 1, "c", date(2026, 8, 2)), ("u", 2, 2, "d", date(2026, 7, 1)), ("u", 3, 1, "e", None), ("v", 1, 1, "f", date(2026, 7, 1))]
    entries = spark.createDataFrame(rows, "list_type string, page int, place int, project_id string, modified_on date")
    walked = lambda c: sorted(r.project_id for r in government.changed_entries(entries, F.lit(c).cast("date")).collect())
    assert walked("2026-08-01") == ["a", "b", "c"]
    assert walked(None) == ["a", "b", "f"]  # the first run reads a page of each type


def test_catalogs_within_depth_and_without_cycles(spark):
    stages = spark.createDataFrame([("p", "1", True, None), ("p", "2", False, None), ("p", "3", True, date(2020, 1, 1))], "project_id string, catalog_id string, visitable boolean, last_modified_on date")
    children = spark.createDataFrame([("1", "10"), ("10", "100"), ("1", "1"), ("10", "1")], "parent_id string, catalog_id string")
    got = {(r.catalog_id, r.level) for r in government.reachable_catalogs(stages, children, F.lit("2026-01-01").cast("date")).collect()}
    assert got == {("1", 1), ("10", 2)}
    assert {r.catalog_id for r in government.reachable_catalogs(stages, children, F.lit(None).cast("date"), depth=3).collect()} == {"1", "3", "10", "100"}


def land(folder, source, address, payload, version=""):
    (folder / source).mkdir(exist_ok=True, parents=True)
    path = folder / source / f"{quote(address, safe='')}{version and '@' + version}.json"
    path.write_text(json.dumps(payload))
    return path


def test_landed_files(spark, tmp_path):
    for n in range(5):
        land(tmp_path / "in", "sejm", f"term10/print/{n}", {"n": n})
    land(tmp_path / "in", "rcl", "a b+c%/ż@x?", {}, "2")
    (tmp_path / "in" / "sejm" / ".hidden.json").write_text("x")
    for folder in (f"{tmp_path}/in", f"file://{tmp_path}/in/"):
        rows = landing.read(spark, folder).collect()
        assert sorted((r.source, r.external_id) for r in rows) == [("rcl", "a b+c%/ż@x?")] + [("sejm", f"term10/print/{n}") for n in range(5)]
    assert {json.loads(r.payload)["n"] for r in rows if r.source == "sejm"} == set(range(5))
    (tmp_path / "none").mkdir()
    assert landing.read(spark, str(tmp_path / "none")).count() == 0


def test_no_landed_file_is_lost(spark, tmp_path):
    """Files of the same and of older times than those read are read, each once."""
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def put(address, seconds):
        os.utime(land(folder, "sejm", address, {}), (seconds, seconds))

    def run():
        query = landing.stream(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        return sorted(r.external_id for r in spark.read.parquet(out).collect())

    put("a", 1000)
    assert run() == ["a"]
    put("b", 1000)
    put("c", 999)
    put("d", 2_000_000_000)
    put("e", 5)
    assert run() == ["a", "b", "c", "d", "e"]
    put("f", 1)
    assert run() == ["a", "b", "c", "d", "e", "f"]
