"""Register of government drafts: saved HTML pages to cards and events, and the walk over them.

HTML needs a parser, for which Spark has no function: pages are parsed in Arrow batches with Python's own ``html.parser`` into
cells; everything that is said about cells (kinds of events, dates, terms) is a column expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import comma_list, day_first_date, minute_timestamp, page_count, roman_term, trailing_number
from ..functions.vocabulary import first_that_holds, government_kind

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

# Labels of a card's rows.
CREATED, TERM, REGISTER_NUMBER = "Data utworzenia", "Kadencja sejmu", "Numer z wykazu"
# Wording of register entries.
ATTRIBUTE = r"\AZmieniono atrybut (projektu|katalogu) (.+?) na:\s*(.*)\z"
CATALOG_ADDED, DOCUMENT_ADDED = r"\ADodano katalog\s+(.+)\z", r"\ADodano dokument\s+(.+)\z"
CREATED_KINDS = (("Stworzono projekt", "project_created"), ("Stworzono katalog", "catalog_created"))
HEADING = "Rejestr zdarzeń dla"
STAGE_ATTRIBUTE = "nazwa etapu"

CARD = "project_id string, title string, metadata map<string,string>, links map<string,string>, stages array<struct<catalog_id:string,heading:string,state:string,modified:string,visitable:boolean>>"
REGISTER = "heading string, parent_href string, rows array<struct<at:string,author:string,description:string,href:string>>"
LISTING = "header string, rows array<struct<href:string,title:string,applicant:string,number:string,created:string,modified:string>>"
DEPTH = 2


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def all(self) -> Iterator[Node]:
        """Elements below in document order, without recursion: pages may nest deeply."""
        stack = self.children[::-1]
        while stack:
            if type(node := stack.pop()) is Node:
                yield node
                stack += node.children[::-1]

    def find(self, tag: str | None = None, cls: str | None = None, href: str | None = None) -> Node | None:
        return next((n for n in self.all() if (tag is None or n.tag == tag) and (cls is None or cls in n.classes) and (href is None or href in n.attrs.get("href", ""))), None)

    def text(self, without: str | None = None) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if type(x) is str:
                out.append(x)
            elif x.tag != without and x.tag not in ("script", "style"):
                stack += x.children[::-1]
                out.append(" " if x.tag in ("br", "div", "p", "li", "td", "tr") else "")
        return " ".join("".join(out).split())

    def own_text(self) -> str:
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: Markup that can be read in one way only: names in letters, values in double quotes, no references in them; elements whose content is no markup are left out.
_NAME, _SPACE = r"[A-Za-z][A-Za-z0-9]*", r"[ \t\r\n]"
_RAW = "script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext"
_ATTRIBUTE = rf'{_SPACE}+([A-Za-z][-A-Za-z0-9_]*)="([^"&<>]*)"'
_PLAIN = re.compile(rf'([^<]+)|<(?!(?:{_RAW})\b)({_NAME})((?:{_ATTRIBUTE.replace("(", "(?:")})*){_SPACE}*(/?)>|</({_NAME})>', re.IGNORECASE | re.ASCII)
_PAIRS = re.compile(_ATTRIBUTE)


def _plain_tree(page: str) -> Node | None:
    """The tree that ``_Tree`` makes of a page, several times as fast; none if any of it is not plain markup."""
    build, end = _Tree.__new__(_Tree), 0
    build.root = build.at = Node("", {}, None)
    for found in _PLAIN.finditer(page):
        if found.start() != end:
            return None
        end = found.end()
        data, tag, attributes, empty, closed = found.groups()
        if tag:
            tag = tag.lower()
            node = Node(tag, {k.lower(): v for k, v in _PAIRS.findall(attributes)} if attributes else {}, build.at)
            build.at.children.append(node)
            if tag not in VOID:
                build.at = node
            if empty:
                build.handle_endtag(tag)
        elif closed:
            build.handle_endtag(closed.lower())
        else:
            build.at.children.append(unescape(data) if "&" in data else data)
    return build.root if end == len(page) else None


def tree(html: str | None) -> Node:
    if (plain := _plain_tree(html or "")) is not None:
        return plain
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _id_after(word: str, href: str) -> str | None:
    found = re.search(rf"/{word}/(\d+)", href)
    return found[1] if found else None


def card_of(html: str | None) -> dict | None:
    nodes = list(tree(html).all())  # walked once
    classed = [(n, n.classes) for n in nodes if "class" in n.attrs]
    links = [n.attrs.get("href", "") for n in nodes if n.tag == "a"]
    register = next((h for h in links if "/projekt/rejestr/projekt/" in h), None)
    known = [register.rsplit("/", 1)[-1]] if register else [x for h in links if "/katalog/" in h and (x := _id_after("projekt", h))]
    if not known:
        return None
    box = next((n for n, c in classed if "projectTitle" in c), None)
    title = box.find(cls="rcl-title") if box else None
    metadata, targets = {}, {}
    for info in (n for n, c in classed if n.tag == "div" and "info" in c):
        for row in (c for c in info.children if isinstance(c, Node) and "row" in c.classes):
            label, value = row.find("div", "col-xs-4"), row.find("div", "col-xs-6")
            name = label.text().removesuffix(":").strip() if label else ""
            if name and value:
                metadata[name] = value.text().strip(" ,")
                if link := value.find("a", href=""):
                    targets[name] = link.attrs.get("href", "")
    stages = []
    for timeline in (n for n, c in classed if n.tag == "ul" and "cbp_tmtimeline" in c):
        for item in (c for c in timeline.children if isinstance(c, Node) and c.tag == "li"):
            below = list(item.all())
            link = next((n for n in below if n.tag == "a" and "/katalog/" in n.attrs.get("href", "")), None)
            catalog = item.attrs.get("id") or (_id_after("katalog", link.attrs["href"]) if link else None)
            if not catalog:
                continue
            boxes = [n for n in below if n.tag == "div"]
            label = next((n for n in boxes if n.attrs.get("class", "").startswith("cbp_tmlabel")), None)
            inner = label.find("div") if label else None
            small = next((n for n in boxes if "small2" in n.classes), None)
            classes = {c for n in boxes if "class" in n.attrs for c in n.classes}
            state = "not_started" if "cbp_tmlabel_notstart" in classes else "current" if "cbp_tmlabel_active" in classes else "done" if "cbp_tmlabel" in classes else "unknown"
            stages.append({"catalog_id": catalog, "heading": (link or inner).text() if link or inner else "", "state": state, "modified": small.text() if small else None, "visitable": link is not None})
    return {"project_id": known[0], "title": title.text() if title else "", "metadata": metadata, "links": targets, "stages": stages}


def _body_rows(page: Node, inside: str | None = None) -> Iterator[Node]:
    for table in (n for n in page.all() if n.tag == "table" and (inside is None or n.attrs.get("id") == inside)):
        for body in (n for n in table.all() if n.tag == "tbody"):
            yield from (n for n in body.children if isinstance(n, Node) and n.tag == "tr")


def _cells(row: Node) -> list[Node]:
    return [c for c in row.children if isinstance(c, Node) and c.tag == "td"]


def register_of(html: str | None) -> dict:
    page = tree(html)
    head = next((n for n in page.all() if n.own_text().startswith(HEADING)), None)
    parent = head.find("a", href="/projekt/rejestr/") if head else None
    rows = []
    for row in _body_rows(page):
        cells = _cells(row)
        if len(cells) > 2 and (said := cells[2].text(without="a")):
            link = cells[2].find("a", href="/katalog/")
            rows.append({"at": cells[0].text(), "author": cells[1].text(), "description": said, "href": link.attrs["href"] if link else None})
    return {"heading": head.own_text() if head else None, "parent_href": parent.attrs["href"] if parent else None, "rows": rows}


def listing_of(html: str | None) -> dict:
    page = tree(html)
    box = next((n for n in page.all() if n.attrs.get("id") == "list"), None)
    header = box.find(cls="col-sm-8") if box else None
    rows = []
    for row in _body_rows(page, "table"):
        cells = _cells(row) + [Node("td", {}, None)] * 5
        link = cells[0].find("a", href="/projekt/")
        if link:
            rows.append({"href": link.attrs["href"], "title": link.text(), "applicant": cells[1].text(), "number": cells[2].text() or None, "created": cells[3].text(), "modified": cells[4].text()})
    return {"header": header.text() if header else "", "rows": rows}


def _parsed(pages: DataFrame, read, kind: str, html: str) -> DataFrame:
    """``pages`` without its HTML and with the struct ``parsed``; pages go through Python a bounded Arrow batch at a time."""

    def parse(column: pd.Series) -> pd.Series:
        return column.map(lambda x: json.dumps(read(x) or {}, ensure_ascii=False))

    # Not deterministic to the optimizer, which would else parse each page again for every filter over the result.
    found = F.from_json(F.pandas_udf(parse, "string").asNondeterministic()(F.col(html)), kind)
    return pages.withColumn("parsed", found).drop(html)


def project_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cards of project pages: ``project_id, title, metadata, programme_url, created_on, term, stages``; pages that are none go.

    A stage has ``catalog_id, ordinal, name, state, last_modified_on, visitable``.
    """
    c = _parsed(pages, card_of, CARD, html).where("parsed.project_id is not null")
    heading = lambda s, k: F.regexp_extract(F.trim(s["heading"]), r"\A(\d+)\.\s*(.*)\z", k)
    numbered = lambda s: F.trim(s["heading"]).rlike(r"\A\d+\.")
    stages = F.transform(
        "parsed.stages",
        lambda s: F.struct(
            s["catalog_id"].alias("catalog_id"),
            F.when(numbered(s), heading(s, 1).try_cast("int")).alias("ordinal"),
            F.when(numbered(s), F.trim(heading(s, 2))).otherwise(F.trim(s["heading"])).alias("name"),
            s["state"].alias("state"),
            day_first_date(F.regexp_extract(F.coalesce(s["modified"], F.lit("")), r"\d{2}-\d{2}-\d{4}", 0)).alias("last_modified_on"),
            s["visitable"].alias("visitable"),
        ),
    )
    of = lambda label: F.try_element_at("parsed.metadata", F.lit(label))
    return c.select(
        *[x for x in c.columns if x != "parsed"],
        F.col("parsed.project_id").alias("project_id"),
        F.col("parsed.title").alias("title"),
        F.col("parsed.metadata").alias("metadata"),
        F.try_element_at("parsed.links", F.lit(REGISTER_NUMBER)).alias("programme_url"),
        day_first_date(of(CREATED)).alias("created_on"),
        roman_term(of(TERM)).alias("term"),
        comma_list(of(REGISTER_NUMBER)).alias("register_numbers"),
        stages.alias("stages"),
    )


def register_changes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Events of change-register pages, one row each, in the page's order (``place``)."""
    r = _parsed(pages, register_of, REGISTER, html)
    kept = [x for x in r.columns if x != "parsed"]
    return classified_changes(r.select(*kept, F.posexplode("parsed.rows").alias("place", "r")).select(*kept, "place", "r.at", "r.author", "r.description", "r.href"))


def classified_changes(rows: DataFrame) -> DataFrame:
    """``rows(at, author, description, href)`` as typed events; an attribute that was cleared has the new value ''."""
    said = F.trim("description")
    attribute, catalog, document = said.rlike(ATTRIBUTE), said.rlike(CATALOG_ADDED), said.rlike(DOCUMENT_ADDED)
    kind = first_that_holds([(attribute, "attribute_changed"), (document, "document_added"), (catalog, "catalog_added"), *((said.startswith(p), k) for p, k in CREATED_KINDS)], "other")
    found = lambda when, pattern, k: F.when(when, F.trim(F.regexp_extract(said, pattern, k)))
    typed = rows.withColumns(
        {
            "occurred_at": minute_timestamp(F.col("at")),
            "kind": kind,
            "attribute": found(attribute, ATTRIBUTE, 2),
            "new_value": found(attribute, ATTRIBUTE, 3),
            "catalog_name": found(catalog, CATALOG_ADDED, 1),
            "document_name": found(document, DOCUMENT_ADDED, 1),
            "catalog_id": F.nullif(F.regexp_extract(F.coalesce("href", F.lit("")), r"/katalog/(\d+)", 1), F.lit("")),
        }
    )
    return typed.where(said != "").drop("at", "href")


def register_subject(pages: DataFrame, html: str = "html") -> DataFrame:
    """What each register is about: ``scope, name, parent_scope, parent_name, parent_id`` out of its heading."""
    r = _parsed(pages, register_of, REGISTER, html)
    h = F.col("parsed.heading")
    whole = r'\ARejestr zdarzeń dla projektu "(.+)"\z'
    nested = r'\ARejestr zdarzeń dla katalogu "(.+?)" w (projekcie|katalogu) "(.+)"\z'
    is_nested = h.rlike(nested)
    where = F.regexp_extract(h, nested, 2)
    href = F.coalesce("parsed.parent_href", F.lit(""))
    parent = F.coalesce(F.nullif(F.regexp_extract(href, r"/katalog/(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(href, r"/projekt/(\d+)", 1), F.lit("")))
    return r.select(
        *[x for x in r.columns if x != "parsed"],
        F.when(is_nested, "catalog").when(h.rlike(whole), "project").alias("scope"),
        F.when(is_nested, F.regexp_extract(h, nested, 1)).when(h.rlike(whole), F.regexp_extract(h, whole, 1)).alias("name"),
        F.when(is_nested, F.when(where == "projekcie", "project").otherwise("catalog")).alias("parent_scope"),
        F.when(is_nested, F.regexp_extract(h, nested, 3)).alias("parent_name"),
        F.when(is_nested, parent).alias("parent_id"),
    )


def stage_transitions(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("kind") == "attribute_changed") & (F.col("attribute") == STAGE_ATTRIBUTE))


def child_catalogs(changes: DataFrame) -> DataFrame:
    """Catalogs filed under a register's subject; entries without a link are left out."""
    return changes.where("kind = 'catalog_added' and catalog_id is not null").withColumn("catalog_name", F.coalesce("catalog_name", "description"))


def documents_filed(changes: DataFrame) -> DataFrame:
    return changes.where("kind = 'document_added'")


def listing_entries(pages: DataFrame, html: str = "html") -> DataFrame:
    """Entries of listing pages with ``total_count``, in the page's order (``place``): null dates count as unknown."""
    r = _parsed(pages, listing_of, LISTING, html)
    kept = [x for x in r.columns if x != "parsed"]
    rows = r.select(*kept, trailing_number(F.col("parsed.header")).alias("total_count"), F.posexplode("parsed.rows").alias("place", "r"))
    project = F.nullif(F.regexp_extract("r.href", r"/projekt/(\d+)", 1), F.lit(""))
    return rows.select(*kept, "total_count", "place", project.alias("project_id"), "r.title", "r.applicant", F.col("r.number").alias("register_number"), day_first_date(F.col("r.created")).alias("created_on"), day_first_date(F.col("r.modified")).alias("modified_on")).where("project_id is not null")


def declared_volumes(listings: DataFrame) -> DataFrame:
    """How many projects of a type the register says it has, of ``listings(list_type, total_count)``; binding."""
    total = listings.groupBy("list_type").agg(F.max("total_count").cast("long").alias("declared"))
    return total.select(F.lit("rcl").alias("source"), F.col("list_type").alias("partition"), F.lit("project").alias("kind"), F.concat(F.lit("projekt/"), "list_type", F.lit("/")).alias("prefix"), "declared", F.lit(True).alias("authoritative"))


def pages_of(total: Column, page_size: Column) -> Column:
    return page_count(total, page_size)


def changed_entries(entries: DataFrame, cursor: Column) -> DataFrame:
    """Entries ``(list_type, page, place, modified_on, ..)`` of an incremental walk.

    Pages come newest first. The walk of a type stops after the first page that holds an entry older than the cursor;
    on the pages it reads, entries on or after the cursor, or undated, are visited. Without a cursor it reads one page.
    """
    older = F.coalesce(F.col("modified_on") < cursor, F.lit(False))
    by_page = entries.groupBy("list_type", "page").agg(F.max(older.cast("int")).alias("older"))
    before = F.coalesce(F.max("older").over(Window.partitionBy("list_type").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = by_page.withColumn("stopped", before).where((F.col("stopped") == 0) & (cursor.isNotNull() | (F.col("page") == 1))).select("list_type", "page")
    return entries.join(read, ["list_type", "page"], "left_semi").where(~older)


def reachable_catalogs(stages: DataFrame, children: DataFrame, since: Column, depth: int = DEPTH) -> DataFrame:
    """Catalogs to visit of each project: ``project_id, catalog_id, level``, each once at its first level.

    ``stages(project_id, catalog_id, visitable, last_modified_on)``, ``children(parent_id, catalog_id)``. Starts from visitable stages
    touched since the cursor (undated ones count) and goes down ``depth`` levels at most, so the number of joins is fixed.
    """
    touched = since.isNull() | F.col("last_modified_on").isNull() | (F.col("last_modified_on") >= since)
    level = stages.where(F.col("visitable") & touched).select("project_id", "catalog_id", F.lit(1).alias("level")).distinct()
    found = level
    for k in range(2, depth + 1):
        below = level.select("project_id", F.col("catalog_id").alias("parent_id")).join(children, "parent_id").select("project_id", "catalog_id").distinct()
        level = below.join(found, ["project_id", "catalog_id"], "left_anti").withColumn("level", F.lit(k))
        found = found.unionByName(level)
    return found


def classified(documents: DataFrame) -> DataFrame:
    """``documents(external_id, payload)`` with their kind; only project cards have a title."""
    rows = documents.withColumn("kind", government_kind(F.col("external_id")))
    cards = project_cards(rows.where("kind = 'rcl-project'").select("external_id", F.col("payload").cast("string").alias("html"))).select("external_id", "title")
    return rows.join(cards.dropDuplicates(["external_id"]), "external_id", "left")
