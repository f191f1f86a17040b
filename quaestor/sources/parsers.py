"""Parsers of laid-out text, XML and JSON into records: plain functions on one document, and their use on DataFrames.

Documents are independent, so each is parsed whole in one task; line order is given as a column."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- pages of laid-out text


def common_edges(pages: Sequence[Sequence[str]]) -> tuple[int, int]:
    """(header, footer): how many first and last lines all pages share, white space apart; 0 for a single page."""
    if len(pages) < 2:
        return 0, 0
    plain = [[" ".join(line.split()) for line in p] for p in pages]
    shortest = min(map(len, plain))

    def shared(order: Callable[[list, int], str], most: int) -> int:
        n = 0
        while n < most and len({order(p, n) for p in plain}) == 1:
            n += 1
        return n

    head = shared(lambda p, n: p[n], shortest)
    return head, shared(lambda p, n: p[-1 - n], shortest - head)


_FOOT = re.compile(r"^\s*(?:(?:PE|AM|PR|AD|RR)[\s\\/_.0-9A-Z-]+|\d+\s*/\s*\d+|-?\s*\d+\s*-?|[A-Z]{2})\s*$")


def unpaginated(pages: Sequence[Sequence[str]]) -> list[str]:
    """The lines of all pages without shared edges, page numbers and references at the foot, and the common margin."""
    head, foot = common_edges(pages)
    out: list[str] = []
    for p in pages:
        lines = list(p[head : len(p) - foot])
        while lines and (not lines[-1].strip() or _FOOT.match(lines[-1])):
            lines.pop()
        while lines and not lines[0].strip():
            lines.pop(0)
        out += lines
    margin = min((len(x) - len(x.lstrip()) for x in out if x.strip()), default=0)
    return [x[margin:].rstrip() for x in out]


def gutter(lines: Sequence[str]) -> int | None:
    """Where the gap between two columns is: of the positions that are blank in every line, the widest run, of equals the one
    nearest the middle; its middle. None if there is none between text."""
    lines = [x for x in lines if x.strip()]
    width = max(map(len, lines), default=0)
    blank = [all(i >= len(x) or x[i] == " " for x in lines) for i in range(width)]
    runs, start = [], None
    for i, b in enumerate([*blank, False]):
        if b and start is None:
            start = i
        elif not b and start is not None:
            if start > 0 and i < width:
                runs.append((start, i))
            start = None
    if not runs:
        return None
    a, z = max(runs, key=lambda r: (r[1] - r[0], -abs((r[0] + r[1]) / 2 - width / 2)))
    return (a + z) // 2


def two_columns(lines: Sequence[str]) -> tuple[list[str], list[str]]:
    """(old, new): the text left and right of the gutter; without one all is new."""
    at = gutter(lines)
    if at is None:
        return [], [x.strip() for x in lines if x.strip()]
    return [x[:at].strip() for x in lines if x[:at].strip()], [x[at:].strip() for x in lines if x[at:].strip()]


AMENDMENT = r"^\s*(?:Amendments?|AM)\s+([0-9]+[a-z]?)\s*$"


def amendment(lines: Sequence[str]) -> dict:
    """A block that begins with 'Amendment N': seq, authors, location, old, new, justification, original language. The body
    follows a line of column heads (Text … Amendment) or stands in one column."""
    out = {"seq": None, "authors": None, "location": None, "old": [], "new": [], "justification": None, "orig_lang": None}
    m = re.match(AMENDMENT, lines[0]) if lines else None
    rest = list(lines[1:]) if m else list(lines)
    out["seq"] = m[1] if m else None
    while rest and not rest[-1].strip():
        rest.pop()
    if rest and (lang := re.match(r"^\s*Or\.\s+([a-z]{2}(?:/[a-z]{2})*)\s*$", rest[-1])):
        out["orig_lang"] = lang[1]
        rest.pop()
    for i, line in enumerate(rest):
        if line.strip() == "Justification":
            out["justification"] = " ".join(x.strip() for x in rest[i + 1 :] if x.strip())
            rest = rest[:i]
            break
    heads = next((i for i, x in enumerate(rest) if re.match(r"^\s*(?:Text|Motion|Draft|Proposal|Present)\b.*\bAmendment\s*$", x)), None)
    top = [x.strip() for x in (rest if heads is None else rest[:heads]) if x.strip()]
    if heads is not None:
        out["old"], out["new"] = two_columns(rest[heads + 1 :])
    out["authors"] = top[0] if top else None
    out["location"] = " ".join(top[1:]) or None if heads is not None else (top[1] if len(top) > 1 else None)
    if heads is None:
        out["new"] = top[2:]
    return out


def fixed_width(lines: Sequence[str], gap: int = 10) -> list[list[str]]:
    """Rows of cells that at least `gap` blanks part."""
    return [re.split(rf"\s{{{gap},}}", x.strip()) for x in lines if x.strip()]


def marked_column(line: str, heads: str, mark: str = "X") -> int | None:
    """Under which head a mark stands: the number of the column whose head begins nearest to it."""
    at = line.find(mark)
    starts = [m.start() for m in re.finditer(r"\S+(?: \S+)*", heads)]
    return min(range(len(starts)), key=lambda i: abs(starts[i] - at)) if at >= 0 and starts else None


def form_sections(lines: Sequence[str], marker: str = r"^\s*\(?([A-I])\)?[.)]\s") -> dict[str, list[str]]:
    """The lines of a form's sections by their letter. A letter that isn't the next or the same one is text of the section."""
    out: dict[str, list[str]] = {}
    now = None
    for x in lines:
        m = re.match(marker, x)
        if m and (now is None or ord(m[1]) == ord(now) + 1):
            now = m[1]
            out[now] = []
            x = x[m.end() :]
        if now and x.strip():
            out[now].append(x.strip())
    return out


class Cursor:
    """A place in a running document: title, considerations (A, B, …, AA), recitals, paragraphs. It only moves on."""

    STATES = ("title", "consideration", "recital", "paragraph")

    def __init__(self):
        self.state, self.number = 0, 0.0

    def move(self, state: str, number: float) -> tuple[str, float]:
        at = self.STATES.index(state)
        if (at, number) < (self.state, self.number):
            raise ValueError(f"{state} {number} comes after {self.STATES[self.state]} {self.number}")
        self.state, self.number = at, number
        return state, number


def letters(text: str) -> int:
    n = 0
    for c in text.lower():
        n = n * 26 + ord(c) - 96
    return n


def roman_number(text: str) -> int:
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in text.lower()]
    return sum(-v if v < max(values[i + 1 :], default=0) else v for i, v in enumerate(values))


def located(lines: Sequence[str]) -> list[tuple[str, float, str]]:
    """(state, number, text) of each line of a document; unmarked lines stay where the one before was."""
    cursor, out = Cursor(), []
    for x in lines:
        text = x.strip()
        if m := re.match(r"^([A-Z]{1,2})\.\s", text):
            place = cursor.move("consideration", letters(m[1]))
        elif m := re.match(r"^\((\d+)\)\s", text):
            place = cursor.move("recital", float(m[1]))
        elif m := re.match(r"^(\d+)([a-z]?)\.\s", text):
            place = cursor.move("paragraph", int(m[1]) + (letters(m[2]) / 100 if m[2] else 0))
        else:
            place = (Cursor.STATES[cursor.state], cursor.number)
        out.append((*place, text))
    return out


# --- XML and JSON


def roll_call(source: str) -> list[dict]:
    """The votes of a roll-call document: id, title, date, and for + - 0 the total and the members by group."""
    out = []
    for vote in ET.fromstring(source).iter("RollCallVote.Result"):
        signs = {}
        for sign, tag in (("+", "Result.For"), ("-", "Result.Against"), ("0", "Result.Abstention")):
            side = vote.find(tag)
            if side is None:
                continue
            groups = {
                g.get("Identifier"): [{"mepid": int(m.get("PersId")) if (m.get("PersId") or "").isdigit() else None, "name": "".join(m.itertext()).strip(), "obscure_id": int(m.get("MepId")) if (m.get("MepId") or "").isdigit() else None} for m in g if m.tag.endswith("Member.Name")]
                for g in side.iter("Result.PoliticalGroup.List")
            }
            signs[sign] = {"total": int(side.get("Number") or sum(map(len, groups.values()))), "groups": groups}
        title = vote.find("RollCallVote.Description.Text")
        out.append({"voteid": vote.get("Identifier"), "ts": vote.get("Date"), "title": " ".join("".join(title.itertext()).split()) if title is not None else None, "votes": signs})
    return out


def member_ids(source: str) -> list[int]:
    """The ids of a member list, in order, each once."""
    return list(dict.fromkeys(int(x.text) for x in ET.fromstring(source).iter("id") if (x.text or "").strip().isdigit()))


def committee_vote(rows: Sequence[Sequence[str]]) -> dict:
    """A vote from table rows: a head row (total, sign), then (group, names with commas)."""
    out, sign = {}, None
    for first, second in (r[:2] for r in rows if len(r) >= 2):
        if re.fullmatch(r"\d+", first.strip()) and second.strip() in ("+", "-", "0"):
            sign = second.strip()
            out[sign] = {"total": int(first), "groups": {}}
        elif sign:
            out[sign]["groups"][first.strip()] = [n.strip() for n in second.split(",") if n.strip()]
    return out


def cleaned(value, dates: Sequence[str] = ("date", "start", "end", "time")):
    """JSON without null and empty entries and links to documents; numbers in date fields, milliseconds since 1970, become ISO texts."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if k == "documentLinks":
                continue
            v = pd.Timestamp(v, unit="ms").isoformat() if k in dates and isinstance(v, int) and not isinstance(v, bool) else cleaned(v, dates)
            if v or v is False or v == 0 and isinstance(v, (int, float)):
                out[k] = v
        return out
    return [cleaned(v, dates) for v in value] if isinstance(value, list) else value


def agenda_references(text: Column) -> Column:
    """struct(procedure_type, reading, epdoc, comdoc, otherdoc) of an agenda item's head, null where absent."""

    def part(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found)

    return F.struct(
        part(r"(\*+[I]*)(?:\s|$)").alias("procedure_type"), part(r"\b(I{1,3})\s+(?:reading|[0-9]{4}/)").alias("reading"), part(r"([0-9]{4}/[0-9]{4}[A-Z]?\([A-Z*]{3}\))").alias("epdoc"),
        part(r"(COM\([0-9]{4}\)[0-9]{4,5})").alias("comdoc"), part(r"((?:T|A|B)[0-9]+-[0-9]{4}/[0-9]{4})").alias("otherdoc"),
    )


def tabling_deadline(text: Column) -> Column:
    """The timestamp after a colon, in either of two formats."""
    tail = F.trim(F.regexp_extract(text, r":\s*(.*)$", 1))
    return F.coalesce(F.try_to_timestamp(tail, F.lit("d.M.yyyy 'at' H.mm")), F.try_to_timestamp(tail, F.lit("d MMMM yyyy, H.mm")))


def first_document(items: Column, types: Sequence[str], title: str) -> Column:
    """The url of the first document of the first item whose type is in a set and whose document's title fits."""
    fits = F.filter(items, lambda i: i["type"].isin(*types) & F.exists(i["docs"], lambda d: d["title"].rlike(title)))
    docs = F.get(fits, F.lit(0))["docs"]
    return F.get(F.filter(docs, lambda d: d["title"].rlike(title)), F.lit(0))["url"]


# --- on DataFrames


def blocks(lines: DataFrame, by: str, pos: str, text: str, marker: str = AMENDMENT) -> DataFrame:
    """(by, block, lines): the lines of each block in order; a marker line begins one. Lines before the first are block 0."""
    from quaestor.operators.ordered import segments

    marked = segments(lines, [by], [pos], F.col(text).rlike(marker), "block")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda r: r[text])
    return marked.groupBy(by, "block").agg(listed.alias("lines"))


def amendments(lines: DataFrame, by: str, pos: str, text: str) -> DataFrame:
    """(by, seq, authors, location, old, new, justification, orig_lang) of every 'Amendment N' block."""
    kind = "seq string, authors string, location string, old array<string>, new array<string>, justification string, orig_lang string"
    key = lines.schema[by].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{by: k, **amendment(list(x))} for k, x in zip(f[by], f["lines"], strict=True)], columns=[by, *(c.split()[0] for c in kind.split(", "))])

    return blocks(lines, by, pos, text).where("block > 0").select(by, "lines").mapInPandas(run, f"`{by}` {key}, {kind}")


def ballots(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """(voteid, ts, title, sign, grp, mepid, name, obscure_id), one row a ballot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["voteid", "ts", "title", "sign", "grp", "mepid", "name", "obscure_id"]
        for f in frames:
            rows = [
                (v["voteid"], v["ts"], v["title"], sign, g, m["mepid"], m["name"], m["obscure_id"])
                for source in f["xml"] if source for v in roll_call(source) for sign, side in v["votes"].items() for g, members in side["groups"].items() for m in members
            ]
            yield pd.DataFrame(rows, columns=columns).astype({"mepid": "Int64", "obscure_id": "Int64"})

    schema = "voteid string, ts string, title string, sign string, grp string, mepid long, name string, obscure_id long"
    return documents.select(F.col(xml).alias("xml")).mapInPandas(run, schema)


@F.pandas_udf(StringType())
def cleaned_json(documents: pd.Series) -> pd.Series:
    """cleaned() on JSON texts."""
    return documents.map(lambda x: json.dumps(cleaned(json.loads(x)), sort_keys=True) if x else None)
