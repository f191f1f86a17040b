import json

from quaestor.operators import association
from quaestor.specs import SCHEMAS


def typed(spark, table, *docs):
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    from pyspark.sql import functions as F

    return rows.select(F.from_json("doc", SCHEMAS[table]).alias("r")).select("r.*")


def test_votes_of_amendments(spark):
    votes = spark.createDataFrame(
        [(2, "v2", "A9-0001/2020 - X - Am 1, 3S=7"), (1, "v1", "A9-0001/2020 - X - Am 3 12/01/2020 10:00 Am 4"), (3, "v3", "RC-B9-0001/2020 - Am 3"), (4, "v4", "A9-0002/2020 - Am 3"), (5, "v5", "A9-0001/2020 - vote"), (6, "v6", None)],
        "pos int, voteid string, title string",
    )
    asked = spark.createDataFrame([("a", "A9-0001/2020", "3"), ("b", "A9-0001/2020", "4"), ("c", "B9-0001/2020", "3"), ("d", None, "3"), ("e", "A9-0001/2020", None), ("f", "A9-0001/2020", "7")], "id string, aref string, seq string")
    got = {r.id: r.vote_ids for r in association.amendment_votes(asked, votes).collect()}
    assert got == {"a": ["v1", "v2"], "b": [], "c": ["v3"], "d": [], "e": [], "f": ["v2"]}
    assert association.amendment_votes(asked.limit(0), votes).count() == 0


def test_procedures_of_votes(spark):
    titles = ["Report A9 - 0001/2020 x", "A9-0002/2020 and 2020/0001(COD)", "A9-0003/2020", "On 2020/0001(COD)", "On 2021/0009(COD) the budget", "the budget", "nothing", None]
    votes = spark.createDataFrame(list(enumerate(titles)), "voteid int, title string")
    by_document = spark.createDataFrame([("A9-0001/2020", "2020/0002(COD)"), ("A9-0001/2020", "2020/0001(COD)")], "doc string, reference string")
    procedures = spark.createDataFrame([("2020/0001(COD)",)], "reference string")
    got = {r.voteid: (r.doc, r.epref) for r in association.vote_procedures(votes, by_document, procedures, {"A9-0002/2020": "x"}, [("the budget", "b"), ("budget", "c")]).collect()}
    assert got == {
        0: ("A9-0001/2020", ["2020/0001(COD)", "2020/0002(COD)"]), 1: ("A9-0002/2020", ["x"]), 2: ("A9-0003/2020", None), 3: (None, ["2020/0001(COD)"]),
        4: (None, ["b"]), 5: (None, ["b"]), 6: (None, None), 7: (None, None),
    }


def test_shadows_go_to_committees_that_are_not_responsible(spark):
    committees = [
        {"type": "Responsible Committee", "committee": ["ENVI"]}, {"type": "Committee Opinion", "committee": ["ITRE", "AGRI"], "shadows": [{"name": "old"}]},
        {"responsible": False, "committee": ["ITRE"]}, {"responsible": True, "committee": ["PECH"]}, {"committee": ["CULT"]},
    ]
    dossiers = typed(spark, "dossiers", {"procedure": {"reference": "r"}, "committees": committees}, {"procedure": {"reference": "none"}})
    groups = [{"start": "2019", "end": "9999-12-31T00:00:00", "Organization": "G", "groupid": "g"}, {"start": "2019", "end": "2020-06", "Organization": "H", "groupid": "h"}]
    members = typed(spark, "members", {"UserID": 1, "Groups": groups})
    acts = spark.createDataFrame(
        [("r", "COMPARL-SHADOW", 1, "N", "2020-01", ["ITRE", "AGRI", "ENVI"], 1), ("r", "COMPARL-SHADOW", 1, "N", "2020-12", ["AGRI", "CULT"], 2), ("r", "COMPARL", 1, "N", "2020-01", ["AGRI"], 3), ("r", "COMPARL-SHADOW", 2, "M", "2020-01", ["AGRI"], 4)],
        "reference string, kind string, UserID long, name string, date string, committee array<string>, pos int",
    )
    out = {r.procedure.reference: r.committees for r in association.with_shadows(dossiers, acts, members, "2021").collect()}
    assert out["none"] is None
    assert [[(s.name, s.abbr) for s in c.shadows or []] for c in out["r"]] == [[], [("old", None), ("N", "g"), ("N", "h"), ("N", "g")], [("N", "g"), ("N", "h")], [], []]


def test_meetings_of_flat_items(spark):
    schema = (
        "pos int, docid string, committee string, src string, time struct<date: string, end: string>, date string, end string, city string, room string, type string, title string, comdossier string, epdoc string, docref string, "
        "tabling_deadline string, procedure string, otherdoc string, comdoc string, reading string, actor map<string, array<struct<name: string, mepref: long>>>"
    )
    base = {"committee": "ENVI", "src": "s"}
    items = [
        {**base, "pos": 2, "date": "2020-03-04", "title": "b", "epdoc": "e", "docref": "d", "actor": {"rapporteur": [{"name": "N", "mepref": 1}, {"mepref": 2}]}},
        {**base, "pos": 1, "date": "2020-03-04", "title": "a", "docref": "lost", "city": "X"}, {**base, "pos": 3, "title": "neither"},
        {**base, "pos": 4, "docid": "M", "time": {"date": "2020-01-01", "end": "z"}, "title": "c"},
    ]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(json.dumps(i),) for i in items], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    got = {r.id: r for r in association.meetings(rows).collect()}
    assert set(got) == {"M", "ENVI(2020)0304_XX"} and got["M"].time.end == "z" and got["M"].city == ""
    made = got["ENVI(2020)0304_XX"]
    assert (made.city, made.time.date, made.time.end) == ("X", "2020-03-04", "")
    assert [(i.title, i.docref, [(a.name, a.type, a.mepref) for a in i.actors or []]) for i in made["items"]] == [("a", None, []), ("b", "d", [("N", "rapporteur", 1)])]


def test_motions_by_year(spark):
    docs = [{"type": "Motion for a resolution", "date": "2020-01-01", "docs": [{"title": "B9-0001/2020", "url": "u"}, {"title": "B9-0002/2020"}, {"title": "x B9-0001/2020", "url": "no"}]}, {"type": "Other", "date": "2020-01-01", "docs": [{"title": "B9-0001/2020", "url": "no"}]}]
    dossiers = typed(spark, "dossiers", {"procedure": {"reference": "r"}, "docs": docs}, {"procedure": {"reference": "none"}})
    assert [tuple(r) for r in association.motions(dossiers).collect()] == [("r", "u", "2020-01-01")]
    assert association.motions(dossiers, [2020]).count() == 1 and association.motions(dossiers, ["2019"]).count() == 0


def test_members_of_ballots(spark):
    ballots = spark.createDataFrame([("v", "2020", "G", 6840, "A", 1), ("v", "2020", "G", 5, "B", 2), ("v", "2020", "G", None, "C", 3), ("v", "2020", "G", None, "D", 4), ("w", "2020", "G", None, "C", 3)], "voteid string, ts string, grp string, mepid long, name string, obscure_id long")
    asked = []

    def resolved(probes):
        asked.extend(r.name for r in probes.collect())
        return probes.selectExpr("probe", "case when name = 'C' then 77L end as member")

    got = sorted(tuple(r) for r in association.ballot_members(ballots, resolved).fillna(-1).fillna("").collect())
    assert sorted(asked) == ["C", "D"]
    assert got == sorted([("v", "2020", "G", 197443, "", -1), ("v", "2020", "G", 5, "", -1), ("v", "2020", "G", 77, "", -1), ("v", "2020", "G", -1, "D", 4), ("w", "2020", "G", 77, "", -1)])
