"""The domain tables and their inverted indexes, declared: a table has a key and a schema, an index a key array and what it keeps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.operators.index import inverted_index
from quaestor.operators.search import normal_name

_SPAN = "`start`: STRING, `end`: STRING"
_BODY = f"role: STRING, Organization: STRING, abbr: STRING, {_SPAN}, term: BIGINT"
_DOCS = "ARRAY<STRUCT<url: STRING, title: STRING>>"
_CHANGES = "changes MAP<STRING, ARRAY<STRUCT<type: STRING, path: ARRAY<STRING>, data: STRING>>>"
_AMENDMENT = "src STRING, peid STRING, reference STRING, `date` STRING, seq STRING, orig_lang STRING, authors STRING, meps ARRAY<BIGINT>, location ARRAY<ARRAY<STRING>>, old ARRAY<STRING>, new ARRAY<STRING>, justification STRING"

SCHEMAS = {
    "members": f"UserID BIGINT, active BOOLEAN, Name STRUCT<full: STRING, sur: STRING, family: STRING, title: STRING, aliases: ARRAY<STRING>>, Gender STRING, Birth STRUCT<`date`: STRING, place: STRING>, "
    f"Groups ARRAY<STRUCT<role: STRING, Organization: STRING, groupid: STRING, {_SPAN}>>, Constituencies ARRAY<STRUCT<party: STRING, country: STRING, {_SPAN}, term: BIGINT>>, Committees ARRAY<STRUCT<{_BODY}>>, "
    f"Delegations ARRAY<STRUCT<{_BODY}>>, Staff ARRAY<STRUCT<role: STRING, Organization: STRING, {_SPAN}, term: BIGINT>>, assistants MAP<STRING, ARRAY<STRING>>, {_CHANGES}",
    "dossiers": "procedure STRUCT<reference: STRING, title: STRING, type: STRING, subtype: STRING, instrument: STRING, legal_basis: ARRAY<STRING>, stage_reached: STRING, subject: MAP<STRING, STRING>, dossier_of_the_committee: ARRAY<STRING>>, celexid STRING, "
    "committees ARRAY<STRUCT<type: STRING, responsible: BOOLEAN, body: STRING, committee: ARRAY<STRING>, committee_full: ARRAY<STRING>, associated: BOOLEAN, `date`: ARRAY<STRING>, rapporteur: ARRAY<STRUCT<name: STRING, mepref: BIGINT, `date`: STRING, `group`: STRING, abbr: STRING>>, "
    f"shadows: ARRAY<STRUCT<name: STRING, mepref: BIGINT, `group`: STRING, abbr: STRING>>>>, council ARRAY<STRUCT<body: STRING, type: STRING, council: STRING, `date`: STRING>>, events ARRAY<STRUCT<`date`: STRING, type: STRING, body: STRING, docs: {_DOCS}>>, "
    f"docs ARRAY<STRUCT<`date`: STRING, type: STRING, body: STRING, docs: {_DOCS}>>, forecasts ARRAY<STRUCT<`date`: STRING, title: STRING>>, {_CHANGES}",
    "amendments": f"id STRING, committee ARRAY<STRING>, {_AMENDMENT}",
    "plenary_amendments": f"id STRING, committee STRING, {_AMENDMENT}, vote_ids ARRAY<STRING>",
    "votes": "voteid STRING, ts STRING, url STRING, title STRING, doc STRING, epref ARRAY<STRING>, votes MAP<STRING, STRUCT<total: BIGINT, groups: MAP<STRING, ARRAY<STRUCT<mepid: BIGINT, name: STRING, obscure_id: BIGINT>>>>>",
    "committee_votes": "id STRING, _id STRING, committee STRING, vote_type STRING, aref STRING, ep_ref STRING, url STRING, ts STRING, votes MAP<STRING, STRUCT<total: BIGINT, groups: MAP<STRING, ARRAY<BIGINT>>>>",
    "activities": "mep_id BIGINT, acts MAP<STRING, ARRAY<STRUCT<`date`: STRING, reference: STRING, title: STRING, url: STRING, term: BIGINT, dossiers: ARRAY<STRING>, committee: ARRAY<STRING>>>>",
    "agendas": "id STRING, committee STRING, src STRING, `time` STRUCT<`date`: STRING, `end`: STRING>, type STRING, city STRING, room STRING, items ARRAY<STRUCT<title: STRING, `start`: STRING, `end`: STRING, RCV: BOOLEAN, epdoc: STRING>>",
}

KEYS: dict[str, Column | Callable[[], Column]] = {
    "members": lambda: F.col("UserID").cast("string"), "dossiers": lambda: F.col("procedure.reference"), "amendments": lambda: F.col("id"),
    "plenary_amendments": lambda: F.col("id"), "votes": lambda: F.col("voteid"), "committee_votes": lambda: F.coalesce("_id", "id"),
    "activities": lambda: F.col("mep_id").cast("string"), "agendas": lambda: F.col("id"),
}
# The dump file of each table, the stages of a procedure that is over, the last day of term 4, and
# the keys of an activity record that are no activity types.
FILES = {
    "members": "ep_meps", "dossiers": "ep_dossiers", "amendments": "ep_amendments", "plenary_amendments": "ep_plenary_amendments",
    "votes": "ep_votes", "committee_votes": "ep_com_votes", "activities": "ep_mep_activities", "agendas": "ep_comagendas",
}
NO_ACTIVITY = ("mep_id", "meta", "changes", "WEXP", "WDECL")
INACTIVE = ("Procedure completed", "Procedure rejected", "Procedure lapsed or withdrawn")
END_OF_TERM_4 = "1999-07-19"


@dataclass(frozen=True)
class IndexSpec:
    """What an index is made of. keys: a row's keys; distinct: each once; keep_null: rows without a key stay; where: which rows take part."""

    table: str
    keys: Callable[[], Column]
    distinct: bool = True
    keep_null: bool = False
    where: Callable[[], Column] | None = None


def _titles(items: str) -> Column:
    return F.flatten(F.transform(items, lambda i: F.transform(i["docs"], lambda d: d["title"])))


def _present(x: Column) -> Column:
    return F.filter(F.array(x), lambda k: k.isNotNull() & (k != ""))


def _committees() -> Column:
    """The bodies of a dossier's committees that have a date in term 5 or later; of a date list the first counts."""
    dated = F.filter("committees", lambda c: F.get(c["date"], F.lit(0)) >= END_OF_TERM_4)
    return F.flatten(F.transform(dated, lambda c: c["committee"]))


def _agenda(voted: bool) -> Column:
    items = F.filter("items", lambda i: i["epdoc"].isNotNull() & (F.coalesce(i["RCV"], F.lit(False)) if voted else F.lit(True)))
    return F.transform(items, lambda i: F.concat(F.col("committee"), i["epdoc"]))


def _status() -> Column:
    return F.when(F.col("procedure.stage_reached").isin(*INACTIVE), "inactive").otherwise("active")


INDEXES = {
    "members_by_activity": IndexSpec("members", lambda: F.array(F.when(F.coalesce("active", F.lit(False)), "active").otherwise("inactive"))),
    "members_by_country": IndexSpec("members", lambda: F.transform("Constituencies", lambda c: c["country"])),
    "members_by_committee": IndexSpec("members", lambda: F.transform("Committees", lambda c: c["abbr"])),
    "members_by_group": IndexSpec("members", lambda: F.transform("Groups", lambda g: g["Organization"])),
    "members_by_name": IndexSpec("members", lambda: F.transform("Name.aliases", normal_name)),
    "amendments_by_member": IndexSpec("amendments", lambda: F.col("meps")),
    "amendments_by_dossier": IndexSpec("amendments", lambda: _present(F.col("reference"))),
    "plenary_amendments_by_member": IndexSpec("plenary_amendments", lambda: F.col("meps")),
    "plenary_amendments_by_dossier": IndexSpec("plenary_amendments", lambda: _present(F.col("reference"))),
    "dossiers_by_subject": IndexSpec("dossiers", lambda: F.map_keys("procedure.subject"), distinct=False),
    "dossiers_by_committee": IndexSpec("dossiers", _committees),
    "committee_votes_by_dossier": IndexSpec("committee_votes", lambda: F.array(F.coalesce("ep_ref", F.lit("")))),
    "committee_votes_by_committee": IndexSpec("committee_votes", lambda: F.array(F.coalesce("committee", F.lit("")))),
    "committee_votes_by_url": IndexSpec("committee_votes", lambda: F.array("url"), keep_null=True),
    "votes_by_dossier": IndexSpec("votes", lambda: F.filter("epref", lambda r: r != "")),
    "votes_by_doc": IndexSpec("votes", lambda: F.array("doc")),
    "dossiers_by_doc": IndexSpec("dossiers", lambda: F.concat(F.coalesce(_titles("docs"), F.array()), F.coalesce(_titles("events"), F.array()))),
    "active_dossiers": IndexSpec("dossiers", lambda: F.array(_status()), where=lambda: F.col("procedure.stage_reached").isNotNull()),
    "agendas_by_committee": IndexSpec("agendas", lambda: F.array("committee")),
    "agendas_by_committee_dossier": IndexSpec("agendas", lambda: _agenda(False), distinct=False),
    "agendas_by_committee_dossier_voted": IndexSpec("agendas", lambda: _agenda(True), distinct=False),
}


_ACTS = SCHEMAS["activities"].split("acts MAP<STRING, ", 1)[1].removesuffix(">")


def typed(name: str, doc: Column) -> Column:
    """A document's JSON text as a row of its table. Fields that come in more than one type are given one: a vote's single
    reference becomes a list, an activity record's types become entries of one map."""
    row = F.from_json(doc, SCHEMAS[name])
    if name == "votes":
        raw = F.get_json_object(doc, "$.epref")
        single = F.when(raw.isNotNull() & ~raw.startswith("["), F.array(raw))
        return row.withField("epref", F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), single))
    if name == "activities":
        fields = F.map_filter(F.from_json(doc, "map<string,string>"), lambda k, v: ~k.isin("acts", *NO_ACTIVITY))
        folded = F.map_filter(F.transform_values(fields, lambda k, v: F.from_json(v, _ACTS)), lambda k, v: v.isNotNull())
        return row.withField("acts", F.coalesce(row["acts"], folded))
    return row


def build(table: DataFrame, spec: IndexSpec) -> DataFrame:
    """The index's rows: the table's with a column k; the change log is left out."""
    rows = table.where(spec.where()) if spec.where else table
    return inverted_index(rows.drop("changes"), spec.keys(), distinct=spec.distinct, keep_null=spec.keep_null)
