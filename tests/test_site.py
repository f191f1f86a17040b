"""The site's operators, outside sources and jobs."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quaestor.cdc import render
from quaestor.cdc.diff import diff
from quaestor.operators import profile, site, subs
from quaestor.service import jobs
from quaestor.sources import external, framed
from quaestor.streaming.jobs import breaker_step

DOSSIERS = """procedure STRUCT<reference: STRING, title: STRING>, committees ARRAY<STRUCT<type: STRING, responsible: BOOLEAN, committee: ARRAY<STRING>, rapporteur: ARRAY<STRUCT<name: STRING, abbr: STRING>>>>,
events ARRAY<STRUCT<`date`: STRING, type: STRING, docs: ARRAY<STRUCT<url: STRING, title: STRING>>>>"""


def test_routes():
    groups, countries = {"S&D", "IND/DEM", "XX"}, {"FR", "XX"}
    assert site.route("IND|DEM", "FR", groups, countries) == ("IND/DEM", "FR") and site.route("FR", "S&D", groups, countries) == ("S&D", "FR")
    assert site.route(None, None, groups, countries) == (None, None) and site.route("S&D", "XX", groups, countries) == ("S&D", "XX")
    for bad in (("no", None), ("FR", "FR"), ("S&D", "IND|DEM")):
        with pytest.raises(LookupError):
            site.route(*bad, groups, countries)


def test_committee_page_and_result_order(spark):
    lead = ("Responsible Committee", None, ["ENVI"], [("Ann", "S&D"), ("Bob", "EPP"), ("Ann", "Greens")])
    rows = [
        (("r1", "one"), [lead, (None, False, ["ITRE"], None)], [("2020", "Other", [("u", "t")]), ("2021", "Legislative proposal", [(None, None)]), ("2022", "Legislative proposal published", [("u2", "COM")])]),
        (("r2", "two"), [(None, True, ["ITRE", "ENVI"], None)], []), (("r3", "three"), [], [("2023", "x", None)]),
    ]
    df = spark.createDataFrame(rows, DOSSIERS)
    envi = {r.reference: r for r in site.committee_dossiers(df, "ENVI").collect()}
    assert set(envi) == {"r1", "r2"} and envi["r1"].role == "Responsible Committee" and envi["r2"].role == "Responsible"
    assert sorted(tuple(p) for p in envi["r1"].rapporteurs) == [("Ann", "Greens"), ("Bob", "EPP")] and envi["r1"].groups == ["EPP", "Greens"] and tuple(envi["r1"].document) == ("u2", "COM")
    assert [r.role for r in site.committee_dossiers(df, "ITRE").orderBy("reference").collect()] == ["Opinion", "Responsible"] and envi["r2"].document is None
    people = spark.createDataFrame([(("B",),), (("A",),)], "Name STRUCT<full: STRING>")
    p, d = site.result_order(people, df)
    assert [r.Name.full for r in p.collect()] == ["A", "B"] and [r.procedure.reference for r in d.collect()] == ["r3", "r1", "r2"]


def test_histories_and_groups(spark):
    span = "STRUCT<Organization: STRING, `start`: STRING, `end`: STRING>"
    df = spark.createDataFrame([([("b", "2", "3"), ("a", "2", "3"), ("c", "1", "9"), ("a", "2", "2")], [("p", "2", "3"), ("o", "2", "3")])], f"Groups ARRAY<{span}>, Constituencies ARRAY<STRUCT<party: STRING, `start`: STRING, `end`: STRING>>")
    r = site.ordered_histories(df).first()
    assert [tuple(x) for x in r.Groups] == [("c", "1", "9"), ("a", "2", "2"), ("a", "2", "3"), ("b", "2", "3")] and [x.party for x in r.Constituencies] == ["o", "p"]
    texts = ["Greens Group", "S&D", "ALDE- x", "Renew Europe group", "Chair -  x", "y - S&D", "y -  Greens  Group", "plain"]
    names = {"Greens Group": "Greens", "Socialists": "S&D"}
    got = [r.g for r in spark.createDataFrame([(t,) for t in texts], "t string").select(site.group_label(F.col("t"), names).alias("g")).collect()]
    assert [tuple(g) if g else None for g in got] == [
        ("Greens", "Greens Group"), ("S&D", "Socialists"), ("ALDE", "Alliance of Liberals and Democrats for Europe"), ("Renew", "Renew Europe group"), ("???", "Unknown Group"), ("S&D", "Socialists"), ("Greens", "Greens Group"), None,
    ]


def test_relational(spark, tmp_path):
    with sqlite3.connect(tmp_path / "n.db") as c:
        c.execute("create table subscriber (id integer primary key, email text)")
        c.executemany("insert into subscriber values (?, ?)", [(i, f"a{i}@x") for i in range(1, 41)])
    df = external.relational(spark, f"sqlite:{tmp_path}/n.db", "subscriber", "id long, email string", parts="4")
    assert df.count() == 40 and df.where("id = 7").first().email == "a7@x"


def test_http():
    waits, answers = [], [external.Answer(500), external.Answer(429), external.Answer(200, "ok")]
    assert external.fetch(lambda u: answers.pop(0), "u", wait=waits.append).body == "ok" and waits == [4, 10]
    with pytest.raises(external.Refused):
        external.fetch(lambda u: external.Answer(404), "u", wait=waits.append)
    waits.clear()
    with pytest.raises(external.Refused):
        external.fetch(lambda u: external.Answer(500), "u", wait=waits.append)
    assert waits == [4, 8, 12, 16, 20] and external.fetch(lambda u: external.Answer(500, "x"), "u", ignored=[500]).body == "x"


def test_pages_and_pdf(spark):
    def get(url):
        return external.Answer(404 if url == "b" else 200, f"page {url}")

    got = {r.url: r for r in external.pages(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "url string"), get).collect()}
    assert got["a"].body == "page a" and got["b"].error and len(got) == 2
    files = spark.createDataFrame([("f", bytearray(b"x\ny\fz\f")), ("g", bytearray(b"\xff"))], "path string, content binary")
    rows = external.pdf_lines(files, lambda b: b.decode()).orderBy("path", "page").collect()
    assert [(r.page, r.lines) for r in rows[:2]] == [(1, ["x", "y"]), (2, ["z"])] and "Decode" in rows[2].error


def test_sources_of_dossiers(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    feed, known = frame([("r1***", "u1"), ("r2", "u2")], "title string, link string"), frame([("r2",)], "reference string")
    active, years = frame([("r3", "u3"), ("r4", "u4")], "reference string, url string"), frame([(" u9 ",), ("",)], "link string")
    assert sorted(r.url for r in external.dossier_sources(years, feed, known, active, ["r4"]).collect()) == ["u1", "u3"]
    assert [r.url for r in external.dossier_sources(years, feed, known, active, [], True).collect()] == ["u9"]
    items = frame([(1, "opinions", "d", "u", "p1"), (2, "reports", "d1", "u", None), (3, "motions", "dx", "u3", None), (4, "motions", "dx", "u4", None), (5, "motions", "dx", "u3+DOC+PDF+", None)], "id int, kind string, reference string, url string, pdf string")
    by_document, by_pdf = frame([("d1", "r2"), ("d1", "r1"), ("d", "no")], "document string, reference string"), frame([("p1", "r7")], "pdf string, reference string")
    by_page = frame([("u3", "r8"), ("u4", "r8"), ("u4", "r9"), ("u3+DOC+PDF+", "r8")], "url string, reference string")
    assert {r.id: r.dossiers for r in external.associated(items, by_document, by_pdf, by_page).collect()} == {1: ["r7"], 2: ["r1", "r2"], 3: ["r8"], 4: [], 5: []}


def test_jobs(spark, tmp_path):
    def work(n):
        if n == 2:
            raise ValueError("two")
        return {"n": n}

    rows = spark.createDataFrame([("mep", i, json.dumps({"n": i})) for i in range(4)], "source string, seq long, job string")
    done = jobs.attempted(rows, work)
    assert [(r.seq, r.error) for r in jobs.dead_letters(done).collect()] == [(2, "ValueError('two')")] and done.where("result is not null").count() == 3
    states = done.withColumn("state", F.when(F.col("error").isNull(), "done").otherwise("failed"))
    assert {(r.state, r.n) for r in jobs.counters(states).collect()} == {("done", 3), ("failed", 1)}
    order = jobs.order()
    assert order.index("meps") < order.index("mep") < order.index("dossiers") < order.index("pvotes") < order.index("plenaries")
    with pytest.raises(ValueError):
        jobs.order({"a": ["b"], "b": ["a"]})
    ran = []
    got = jobs.run_chain("a", {}, {"a": lambda j: ran.append("a"), "b": lambda j: 1 / 0, "c": lambda j: ran.append("c"), "d": lambda j: ran.append("d")}, {"a": ["b", "c"], "b": ["d"]})
    assert ran == ["a", "c"] and isinstance(got["b"], ZeroDivisionError) and "d" not in got
    (tmp_path / "mep.py").write_text("CONFIG = {'threads': 2}\ndef scrape(n):\n    return n\n")
    (tmp_path / "bad.py").write_text("1 / 0\n")
    (tmp_path / "_helper.py").write_text("")
    found, errors = jobs.plugins(str(tmp_path))
    assert list(found) == ["mep"] and found["mep"].CONFIG == {**jobs.DEFAULTS, "threads": 2} and list(errors) == ["bad"]


def test_hook_and_results(spark):
    rows = spark.createDataFrame([("a", None, ["x"]), ("b", "bad", ["x"]), ("c", None, [])], "key string, error string, changes array<string>")
    seen = []
    assert jobs.on_changed(rows, lambda df: seen.append([r.key for r in df.collect()])) and seen == [["a"]]
    assert not jobs.on_changed(rows.where("key = 'c'"), seen.append)
    now, made = [0.0], []
    results = jobs.Results(lambda: now[0])
    make = lambda: made.append(1) or spark.range(3)
    first = results.get("k", 10, make)
    assert results.get("k", 10, make) is first and len(made) == 1
    now[0] = 11
    assert results.get("k", 10, make).count() == 3 and len(made) == 2


def test_templates_and_reports(spark):
    changes = diff({"a": {"b": 1, "c": "<x>"}}, {"a": {"b": 2}, "d": "new"})
    assert render.rendered(changes) == "a\n   b: \033[31m1\033[32m2\033[0m\n   c: \033[31m<x>\033[0m\nd: \033[32mnew\033[0m\n"
    for name in ("semantic", "table", "mail"):
        text = render.rendered(changes, name)
        assert text.startswith(render.TEMPLATES[name]["header"]) and "&lt;x&gt;" in text and text.count("<ins") == 2 and text.count("<del") == 2
    docs = spark.createDataFrame([('{"meta":{"updated":"2020"},"a":[1,2]}',), ('{"meta":{"created":"2018"},"b":"x"}',)], "doc string")
    got = profile.reports(docs, "doc", "things", "2019")
    assert set(got) == {"things", "things_v1"} and "<b>a</b> list 200.00%" in got["things"] and "<b>b</b>" in got["things_v1"]


def test_searches_meet_rows_by_their_terms(spark):
    changed = spark.createDataFrame([("r1", ["s"], "Fish and chips\nabc"), ("r2", [], "a fish"), ("r3", [], None)], "key string, subjects array<string>, title string")
    items = spark.createDataFrame([("search", "FISH chip", 1, None), ("search", "abc fish", 2, None), ("search", "a", 3, None), ("search", "fish", 4, "pending"), ("subject", "s", 5, None), ("search", " ", 6, None)], "type string, name string, group_id int, activation_key string")
    who = spark.createDataFrame([(g, f"m{g}", None) for g in range(1, 7)], "group_id int, email string, activation_key string")
    got = {(r.key, r.email) for r in subs.recipients(changed, items, who, [F.col("title")]).collect()}
    assert got == {("r1", "m1"), ("r1", "m3"), ("r2", "m3"), ("r1", "m5")}


def test_dump_versions(spark, tmp_path):
    path = f"{tmp_path}/dump"
    for n in (100, 0, 7):
        framed.write(spark.range(n).repartition(3) if n else spark.range(0), path)
        assert framed.read(spark, path).count() == n
    lines = [r.value for r in spark.read.text(framed.current(spark, path)).collect()]
    assert len(json.loads("".join(sorted(lines, key=lambda x: "[,]".index(x[0]))))) == 7
    assert len([p for p in (tmp_path / "dump").iterdir() if p.name.startswith("version-")]) == 2


def test_breaker_forgets_when_idle():
    assert breaker_step([], 0, iter([True] * 12), iter([False] * 12))[1] == 1
    assert breaker_step([], 0, iter([True] * 12), iter([i == 6 for i in range(12)]))[:2] == ([1] * 6, 0)
