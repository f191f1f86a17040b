"""A procedure's page: its sections as lists of records.

A section stands under a heading, as a table, or as an item of an accordion with tables of its own. Each section is declared by
where its rows are and what its cells mean; a row with another number of cells raises BadPage, as the page has changed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.sources.dom import Element, parse, rows

# Headings and class names of the page.
PLAYERS, EVENTS, FORECASTS, FINAL = "Key players", "Key events", "Forecasts", "Final act"
COUNCIL, COMMISSION = "Council of the European Union", "European Commission"
ITEM, TABLE, GATEWAY = "es_accordion-item", "table-responsive", "erplAccordionDocGateway"
CODED = ("National parliaments", "European Parliament", "Other institutions and bodies")  # sections of documents with a code column
UNTYPED_FINAL = "Final act published in Official Journal"


class BadPage(ValueError):
    """The page isn't laid out as expected."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise BadPage(what)


def day(text: str) -> str | None:
    """A date d/m/Y as it is stored; None for an empty text."""
    return datetime.strptime(text, "%d/%m/%Y").isoformat() if text else None


def _heading(root: Element, title: str) -> Element | None:
    return next(iter(root.all("h2", where=lambda e: e.text == title)), None)


def _table(root: Element, title: str) -> Iterator[list[Element]]:
    """The rows in the body of the table that stands beside the block of a heading."""
    heading = _heading(root, title)
    around = heading.up(3) if heading else None
    for box in around.elements if around else []:
        if box.tag == "div" and TABLE in box.classes:
            for body in box.all("tbody"):
                yield from rows(body)


def _accordion(root: Element, title: str, label: str) -> Iterator[list[Element]]:
    """The rows of the tables in an item of the accordion under a heading, without their first."""
    heading = _heading(root, title)
    around = heading.up(3) if heading else None
    first = True
    for item in around.all("li", where=lambda e: ITEM in e.classes) if around else []:
        if any(s.text == label for b in item.elements if b.tag == "button" for s in b.elements if s.tag == "span"):
            for table in item.all("table"):
                for cells in rows(table):
                    if not first:
                        yield cells
                    first = False


def council(root: Element) -> list[dict]:
    out = []
    for cells in _accordion(root, PLAYERS, COUNCIL):
        _need(len(cells) == 3, "council row without 3 cells")
        names = [s.text for a in cells[0].all("a") for s in a.elements if s.tag == "span"]
        links = cells[1].all("a")
        name = names[0] if len(names) == 1 else cells[0].text
        _need(bool(name) and len(links) == 1, "council row without a configuration or one link")
        row = {"body": "CSL", "type": "Council Meeting", "council": name, "meeting_id": links[0].text, "url": links[0].get("href")}
        out.append(row | ({"date": day(cells[2].text)} if cells[2].text else {}))
    return out


def commission(root: Element) -> list[dict]:
    out = []
    for cells in _accordion(root, PLAYERS, COMMISSION):
        _need(len(cells) == 2, "commission row without 2 cells")
        links, people = cells[0].all("a"), [e for e in cells[1].elements if e.tag == "span"]
        name = links[0].text if len(links) == 1 else cells[0].text
        _need(bool(name), "commission row without a department")
        out.append({"body": "EC", "dg": name} | ({"commissioner": people[0].text} if len(people) == 1 else {}))
    return out


def _docs(cell: Element, base: str | None, default: str = "") -> list[dict]:
    """The links of a cell, and its spans outside links that have text of their own."""
    out = []
    for a in cell.all("a"):
        title = a.text or a.get("title") or default
        _need(bool(title), "link without a name")
        out.append({"url": urljoin(base, a.get("href") or "") if base else a.get("href"), "title": title})
    return out + [{"title": s.own_text} for s in cell.all("span", where=lambda e: not e.within("a") and bool(e.own_text))]


def _summary(cell: Element, base: str, fetch: Callable[[str], list] | None) -> list | None:
    """What the button of a cell leads to; None without one."""
    links = [a for a in cell.elements if a.tag == "a" and any(b.tag == "button" for b in a.elements)]
    _need(len(links) < 2, "more than one summary")
    if not links:
        return None
    url = urljoin(base, links[0].get("href") or "")
    return fetch(url) if fetch else [url]


def events(root: Element, base: str, bodies: Mapping[str, str], fetch: Callable[[str], list] | None = None) -> tuple[list[dict], list[dict]]:
    """(events, what they say of their documents). bodies: type of event -> institution."""
    out, seen = [], []
    for cells in _table(root, EVENTS):
        _need(len(cells) == 4 and bool(cells[0].text), "event row without 4 cells or a date")
        event = {"date": day(cells[0].text), "type": cells[1].text}
        if bodies.get(event["type"]):
            event["body"] = bodies[event["type"]]
        if docs := _docs(cells[2], base, event["type"]):
            event["docs"] = docs
        summary = _summary(cells[3], base, fetch)
        if summary is not None:
            event["summary"] = summary
        if docs:
            seen.append({k: event[k] for k in ("date", "docs", "summary") if k in event})
        out.append(event)
    return out, seen


def docs(root: Element, base: str, known: list[dict], committees: Mapping[str, str], fetch: Callable[[str], list] | None = None) -> list[dict]:
    """The documents by institution, without those with a summary that an event has with the same date, links and summary."""
    out = []
    for section in (li for div in root.all("div", where=lambda e: e.get("id") == GATEWAY) for ul in div.elements if ul.tag == "ul" for li in ul.elements):
        names = [s.own_text for b in section.elements if b.tag == "button" for s in b.elements if s.tag == "span" and "t-x" in s.classes]
        if len(names) != 1:
            continue
        at = int(names[0] in CODED)
        for cells in (c for box in section.all("div", where=lambda e: TABLE in e.classes) for body in box.all("tbody") for c in rows(body)):
            _need(len(cells) == 4 + at, f"document row of {names[0]} without {4 + at} cells")
            doc = {"date": day(cells[2 + at].text)} if cells[2 + at].text else {}
            if found := _docs(cells[1 + at], None):
                doc["docs"] = found
            kind = {"type": cells[0].text, "body": names[0]}
            code = cells[1].text if at else ""
            if code and names[0] != "European Parliament":
                kind["body"] = code
            elif code:
                _need(code in committees, f"unknown committee {code}")
                kind["committee"] = code
            summary = _summary(cells[3 + at], base, fetch)
            if summary is not None:
                doc["summary"] = summary
                if doc | ({"committee": code} if "committee" in kind else {}) in known:
                    continue
            out.append(doc | kind)
    return out


def forecasts(root: Element) -> list[dict]:
    out = []
    for cells in _table(root, FORECASTS):
        _need(len(cells) == 2 and bool(cells[0].text) and bool(cells[1].text), "forecast row without date and title")
        out.append({"date": day(cells[0].text), "title": cells[1].text})
    return out


def final_act(root: Element, base: str, fetch: Callable[[str], list] | None = None) -> dict:
    """Links and summary of the act that ends a procedure."""
    heading = _heading(root, FINAL)
    block = heading.up(2) if heading else None
    out: dict = {}
    after = block.next() if block else None
    while after is not None:
        for li in (li for ul in after.elements if after.tag == "div" and ul.tag == "ul" for li in ul.elements if li.tag == "li"):
            plain = li.all("a", where=lambda a: not any(b.tag == "button" for b in a.elements))
            found = [{"title": a.text, "url": urljoin(base, a.get("href") or "")} for a in plain]
            if found:
                out["docs"] = out.get("docs", []) + found
            if (summary := _summary(li, base, fetch)) is not None:
                out["summary"] = summary
        after = after.next()
    return out


def dossier(page: str, url: str, bodies: Mapping[str, str] = {}, committees: Mapping[str, str] = {}, fetch: Callable[[str], list] | None = None) -> dict | None:  # noqa: B006
    """The record of a page; None if it says that there is no such procedure."""
    root = parse(page)
    if any("ep_name" in e.classes and "This procedure or document does not exist!" in e.text for e in root.all("span")):
        return None
    titles = [[e.text for e in root.all("h2", where=lambda e, c=c: e.classes == [c, "mb-3"])] for c in ("es_title-h1", "es_title-h2")]
    _need(len(titles[0]) == 1 and bool(titles[1]), "no reference or title")
    found, seen = events(root, url, bodies, fetch)
    out = {
        "meta": {"source": url}, "procedure": {"reference": titles[0][0], "title": titles[1][0]}, "council": council(root), "commission": commission(root),
        "forecasts": forecasts(root), "events": found, "docs": docs(root, url, seen, committees, fetch),
    }
    act = final_act(root, url, fetch)
    if act.get("docs"):
        out["procedure"]["final"] = act["docs"][0]
        for event in (e for e in found if e["type"] == UNTYPED_FINAL):
            if act.get("summary"):
                event["summary"] = act["summary"]
            if len(act["docs"]) > 1:
                event["docs"] = event.get("docs", []) + act["docs"]
            break
    return out


def dossiers(pages: DataFrame, bodies: Mapping[str, str] = {}, committees: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """(url, doc, error) of pages (url, html): the record as JSON, or what is wrong with the page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url, html in zip(f["url"], f["html"], strict=True):
                try:
                    doc = dossier(html or "", url or "", bodies, committees)
                    out.append((url, json.dumps(doc, ensure_ascii=False) if doc else None, None if doc else "no such procedure"))
                except ValueError as e:
                    out.append((url, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "doc", "error"])

    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(run, "url string, doc string, error string")
