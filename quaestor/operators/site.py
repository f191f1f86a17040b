"""What the site's pages ask for: filters of its routes, the page of a committee, the order of results and of histories."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.operators import interval

# The types of the event that begins a procedure.
INITIAL = (
    "Non-legislative initial document", "Non-legislative basic document published", "Commission/Council: initial legislative document",
    "Legislative proposal", "Legislative proposal published",
)
HISTORIES = ("Constituencies", "Groups", "Committees", "Delegations", "Staff")


def route(first: str | None, second: str | None, groups: Collection[str], countries: Collection[str]) -> tuple[str | None, str | None]:
    """(group, country) that the parts of a path ask for, a bar in them standing for a slash. LookupError if a part is neither,
    or asks for what the other one has."""
    first, second = (p.replace("|", "/") if p is not None else None for p in (first, second))
    group = first if first in groups else None
    country = first if group is None and first in countries else None
    if first is not None and group is None and country is None:
        raise LookupError(first)
    if second is not None:  # what both could be is a country, unless there is one
        if country is None and second in countries:
            country = second
        elif group is None and second in groups:
            group = second
        else:
            raise LookupError(second)
    return group, country


def members(rows: DataFrame, date: str, group: str | None = None, country: str | None = None, active: bool = True) -> DataFrame:
    """Members, active or not, whose group and constituency at a date are those asked for."""
    out = rows.where(F.coalesce("active", F.lit(False)) == active)
    at = F.lit(date)
    if group is not None:
        out = out.where(F.exists("Groups", lambda g: (g["groupid"] == group) & interval.valid_at(at, g["start"], g["end"])))
    if country is not None:
        out = out.where(F.exists("Constituencies", lambda c: (c["country"] == country) & interval.valid_at(at, c["start"], c["end"])))
    return out


def _last_by_name(people: Column) -> Column:
    """People in order, of each name the last one."""
    places = F.sequence(F.lit(1), F.size(people))
    rows = F.transform(places, lambda i: F.struct(i.alias("at"), F.get(people, i - 1).alias("who")))
    later = F.filter(rows, lambda r: ~F.exists(rows, lambda x: (x.at > r.at) & (x.who["name"] == r.who["name"])))
    return F.when(F.size(people) > 0, F.transform(later, lambda r: r.who)).otherwise(people)


def committee_dossiers(dossiers: DataFrame, committee: str) -> DataFrame:
    """(reference, title, role, rapporteurs, groups, document) of a committee's dossiers.

    role: the type of its first entry, else by whether it is responsible. rapporteurs: of the responsible committees, each name
    once. groups: their distinct labels in order. document: the first one, with a title, of the first event that begins a procedure and has documents."""
    mine = F.get(F.filter("committees", lambda c: F.array_contains(c["committee"], committee)), F.lit(0))
    role = F.coalesce(mine["type"], F.when(mine["responsible"], "Responsible").otherwise("Opinion"))
    leading = F.filter("committees", lambda c: F.coalesce(c["type"] == "Responsible Committee", F.lit(False)) | F.coalesce(c["responsible"], F.lit(False)))
    people = _last_by_name(F.flatten(F.filter(F.transform(leading, lambda c: c["rapporteur"]), lambda r: r.isNotNull())))
    labels = F.array_sort(F.array_distinct(F.filter(F.transform(people, lambda r: r["abbr"]), lambda a: a.isNotNull() & (a != ""))))
    begun = F.filter("events", lambda e: e["type"].isin(*INITIAL) & (F.size(F.coalesce(e["docs"], F.array().cast("array<struct<url:string,title:string>>"))) > 0))
    titled = F.filter(begun, lambda e: F.get(e["docs"], F.lit(0))["title"].isNotNull())
    rows = dossiers.where(mine.isNotNull())
    document = F.get(F.get(titled, F.lit(0))["docs"], F.lit(0))
    return rows.select("procedure.reference", "procedure.title", role.alias("role"), people.alias("rapporteurs"), labels.alias("groups"), document.alias("document"))


def result_order(people: DataFrame, dossiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search results in order: people by name, dossiers by the date of their last event, the latest first."""
    last = F.array_max(F.transform("events", lambda e: e["date"]))
    return people.orderBy("Name.full"), dossiers.orderBy(F.coalesce(last, F.lit("")).desc(), "procedure.reference")


def ordered_histories(rows: DataFrame) -> DataFrame:
    """Members with each list of dated entries in order of start, end, and body or party."""
    for name in HISTORIES:
        if name in rows.columns:
            rows = rows.withColumn(name, _sorted(name, rows.schema[name].dataType.elementType.names))
    return rows


def _sorted(name: str, fields: list[str]) -> Column:
    labels = [f for f in ("Organization", "party") if f in fields]

    def key(e: Column) -> Column:
        return F.struct(e["start"].alias("a"), e["end"].alias("z"), (F.coalesce(*(e[f] for f in labels)) if labels else F.lit("")).alias("label"))

    keyed = F.transform(name, lambda e, i: F.struct(key(e).alias("key"), i.alias("at"), e.alias("entry")))
    by = F.array_sort(keyed, lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(a["at"] - b["at"]))
    return F.transform(by, lambda e: e.entry)


def group_label(text: Column, names: Mapping[str, str]) -> Column:
    """struct(abbr, name) of a written group. names: name -> abbreviation. The text is a name, an abbreviation, or either after
    'label - '; two written forms are fixed. Without a match: ???, Unknown Group; null without a dash to cut at."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    to_abbr = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    to_name = F.create_map(*(F.lit(x) for name, abbr in names.items() for x in (abbr, name)))

    def pair(abbr: Column, name: Column) -> Column:
        return F.struct(abbr.alias("abbr"), name.alias("name"))

    def known(t: Column) -> Column:
        by_name, by_abbr = F.try_element_at(to_abbr, t), F.try_element_at(to_name, t)
        return F.when(by_name.isNotNull(), pair(by_name, t)).when(by_abbr.isNotNull(), pair(t, by_abbr))

    tail = F.trim(F.regexp_extract(plain, r"^.*? - (.*)$", 1))
    written = (
        F.when(plain.startswith("ALDE- "), pair(F.lit("ALDE"), F.lit("Alliance of Liberals and Democrats for Europe")))
        .when(plain == "Renew Europe group", pair(F.lit("Renew"), plain))
    )
    return F.coalesce(known(plain), written, known(tail), F.when(F.instr(plain, " - ") > 0, pair(F.lit("???"), F.lit("Unknown Group"))))
