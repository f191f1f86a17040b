import json

import pytest

from quaestor.specs import FILES, INDEXES, SCHEMAS
from quaestor.store import Store

OPEN = "9999-12-31T00:00:00"
T = "T00:00:00"


def member(i, name, country, group, **more):
    return {
        "UserID": i, "active": i != 3, "Name": {"full": name, "aliases": [name, name.split()[-1]]},
        "Groups": [{"role": "Member", "Organization": f"Group {group}", "groupid": group, "start": "2019-07-02" + T, "end": OPEN}],
        "Constituencies": [{"party": f"P{i}", "country": country, "start": "2014-07-01" + T, "end": "2019-07-01" + T}, {"party": f"P{i}", "country": country, "start": "2019-07-02" + T, "end": OPEN}],
        "Committees": [{"role": "Chair" if i == 1 else "Member", "Organization": "Envi body", "abbr": "ENVI", "start": "2019-07-02" + T, "end": OPEN}], "Staff": [], **more,
    }


DUMPS = {
    "members": [member(1, "Ann Alpha", "DE", "G1"), member(2, "Bob Beta", "FR", "G1"), member(3, "Cy Alpha", "DE", "G2"), member(4, "Dee Delta", "FR", "G2"), member(4, "Dee Delta", "FR", "G2")],
    "dossiers": [
        {"procedure": {"reference": "2020/0001(COD)", "title": "Green foo bar", "stage_reached": "Procedure completed", "subject": {"1.10": "One"}}, "committees": [{"type": "Responsible Committee", "committee": ["ENVI"], "date": ["2020-01-01"], "rapporteur": [{"mepref": 1}], "shadows": [{"mepref": 2}, {"mepref": 99}]}],
         "docs": [{"docs": [{"title": "D1", "url": "u"}]}], "events": [{"docs": [{"title": "D1"}, {"title": "D2"}]}]},
        {"procedure": {"reference": "2020/0002(COD)", "title": "Other", "subject": {"1.10": "One more", "2": "Two"}}, "committees": [{"responsible": False, "committee": ["ITRE"], "rapporteur": [{"mepref": 2}]}]},
    ],
    "amendments": [{"id": "a1", "reference": "2020/0001(COD)", "date": "2020-02-01" + T, "meps": [1, 2, 2]}, {"id": "a2", "date": "2020-02-01" + T, "meps": [1, 3]}],
    "plenary_amendments": [{"id": "p1", "reference": "2020/0001(COD)", "meps": [1]}],
    "votes": [{"voteid": "v1", "ts": "2020-03-01" + T, "epref": "2020/0001(COD)", "doc": "D1", "votes": {"+": {"total": 2, "groups": {"G1": [{"mepid": 1}, {"mepid": 2}]}}, "-": {"total": 2, "groups": {"G1": [{"mepid": 3}], "G2": [{"mepid": 4}, {"name": "lost"}]}}}}],
    "committee_votes": [{"id": "c1", "committee": "ENVI"}],
    "activities": [{"mep_id": 2, "meta": {}, "COMPARL-SHADOW": [{"dossiers": ["2020/0002(COD)", "none"]}], "CRE": [{"title": "x", "dossiers": ["2020/0001(COD)"]}]}],
    "agendas": [{"id": "g1", "committee": "ENVI", "items": [{"epdoc": "2020/0001(COD)", "RCV": True}, {"epdoc": "2020/0001(COD)", "RCV": False}, {"title": "break"}]}],
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dumps")
    for name, docs in DUMPS.items():
        (folder / f"{FILES[name]}.json").write_text("[" + "\n,".join(json.dumps(d) for d in docs) + "\n]")
    s = Store(spark, folder=str(folder))
    for name in SCHEMAS:
        s.tables[name] = s.table(name).cache()
    return s


def pairs(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_tables_and_lookups(store, spark):
    assert store.count("members") == 4 and store.count("members", "1") == 1 and store.count("members", "77") == 0
    assert [r.UserID for r in store.get_many("members", ["2", "9", "1"]).orderBy("pos").collect()] == [2, None, 1]
    assert Store(spark, folder="/nowhere").count("votes") == 0
    assert ("2020/0001(COD)", 4) in pairs(store.keys("dossiers", count=True), "key", "n")
    other = Store(spark, {"votes": store.table("votes")})
    other.put("votes", spark.createDataFrame([("v1", "new"), ("v2", "x")], "voteid string, title string"))
    assert pairs(other.table("votes"), "voteid", "title") == [("v1", "new"), ("v2", "x")]


@pytest.mark.parametrize("name", INDEXES)
def test_indexes(store, name):
    got = {r.key: r.n for r in store.keys(name, count=True).collect()}
    ref = "2020/0001(COD)"
    want = {
        "members_by_activity": {"active": 3, "inactive": 1}, "members_by_country": {"DE": 2, "FR": 2}, "members_by_committee": {"ENVI": 4},
        "members_by_group": {"Group G1": 2, "Group G2": 2}, "members_by_name": {"annalpha": 1, "alpha": 2, "bobbeta": 1, "beta": 1, "cyalpha": 1, "deedelta": 1, "delta": 1},
        "amendments_by_member": {1: 2, 2: 1, 3: 1}, "amendments_by_dossier": {ref: 1}, "plenary_amendments_by_member": {1: 1}, "plenary_amendments_by_dossier": {ref: 1},
        "dossiers_by_subject": {"1.10": 2, "2": 1}, "dossiers_by_committee": {"ENVI": 1}, "committee_votes_by_dossier": {"": 1}, "committee_votes_by_committee": {"ENVI": 1},
        "committee_votes_by_url": {None: 1}, "votes_by_dossier": {ref: 1}, "votes_by_doc": {"D1": 1}, "dossiers_by_doc": {"D1": 1, "D2": 1}, "active_dossiers": {"inactive": 1},
        "agendas_by_committee": {"ENVI": 1}, "agendas_by_committee_dossier": {"ENVI" + ref: 2}, "agendas_by_committee_dossier_voted": {"ENVI" + ref: 1},
    }
    assert got == want[name]


def test_people(store, spark):
    assert pairs(store.names([1, 9]), "UserID", "name") == [(1, "Ann Alpha")]
    assert pairs(store.countries([1, 2, 9], "2020-01-01" + T), "UserID", "country") == [(1, "DE"), (2, "FR")]
    probes = [("x", "Ann Alpha", None, None, None), ("y", "Alpha", None, None, None), ("z", "ALPHA", "2020-01-01" + T, None, "G2"), ("n", "Nobody", None, None, None)]
    got = store.resolve_name(spark.createDataFrame(probes, "probe string, name string, date string, group string, abbr string"))
    assert pairs(got, "probe", "member") == [("n", None), ("x", 1), ("y", None), ("z", 3)]
    assert pairs(store.active_groups(), "groupid") == [("G1",), ("G2",)]
    assert pairs(store.coauthors(1), "name", "group", "country", "n") == [("Bob Beta", "G1", "FR", 2), ("Cy Alpha", "G2", "DE", 1)]
    ranked = store.ranked({"Member": 2}, {"Chair": 5}, {}, "2020-01-01" + T).collect()
    assert [(r.UserID, r.score) for r in ranked][:2] == [(1, 7.0), (2, 2.0)]
    assert [r.UserID for r in store.roster("ENVI", {"Chair": 3}).collect()][0] == 1


def test_dossiers(store):
    got = pairs(store.dossiers_by_member(), "k", "reference", "type")
    assert set(got) == {
        (1, "2020/0001(COD)", "Responsible Committee"), (2, "2020/0001(COD)", "Responsible Committee Shadow"), (2, "2020/0002(COD)", "Committee Opinion"), (2, "2020/0002(COD)", "Committee Opinion Shadow"),
    }
    assert pairs(store.subject_titles(), "subject", "title") == [("1.10", "One more"), ("2", "Two")]
    assert pairs(store.activities_by_dossier(), "k", "type", "name")[0] == ("2020/0001(COD)", "CRE", "Bob Beta")
    assert set(store.activities(2, dossier="2020/0001(COD)").first().acts) == {"CRE"}
    assert pairs(store.committees("2021"), "committee", "active", "dossiers") == [("ENVI", True, 1)]
    assert pairs(store.search("bar foo"), "kind", "key") == [("dossier", "2020/0001(COD)")]
    assert pairs(store.search("ann alpha"), "kind", "key") == [("person", "1")]


def test_votes(store):
    got = {(r.level, r.grp, r.country): (r.plus, r.minus, r.total) for r in store.vote_matrix().collect()}
    assert got["cell", "G1", "DE"] == (1, 1, 2) and got["cell", "G2", "FR"] == (0, 1, 1) and got["group", "G1", None] == (2, 1, 3) and got["country", None, "FR"] == (1, 1, 2)
    assert {r.entity: r.t for r in store.cohesion().collect()} == {"DE": 0.0, "FR": 0.0}
    assert store.similarity().count() == 1
