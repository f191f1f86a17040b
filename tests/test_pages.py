"""Page and amendment parsers on small pages of their layouts."""

import json

import pytest
from pyspark.sql import functions as F

from quaestor.sources import amendment_text as at
from quaestor.sources import dom, dossier_page

PAGE = """<html><body><h2 class="es_title-h1 mb-3">2021/0001(COD)</h2><h2 class="es_title-h2 mb-3">A title &amp; more</h2>
<div><div><div><h2 class="es_title-h2 mb-2">Key players</h2></div></div>
<ul><li class="es_accordion-item"><button><span>Council of the European Union</span></button><table><thead><tr><th>Council configuration</th><th>Meeting</th><th>Date</th></tr></thead>
<tbody><tr><td><a><span>Environment</span></a></td><td><a href="http://m/3"><span>3765</span></a></td><td>01/02/2021</td></tr></tbody></table></li>
<li class="es_accordion-item"><button><span>European Commission</span></button><table><thead><tr><th>DG</th><th>Commissioner</th></tr></thead><tbody><tr><td><a><span>Climate Action</span></a></td><td><span>NAME Some</span></td></tr></tbody></table></li></ul></div>
<div><div><div><h2 class="es_title-h2 mb-2">Key events</h2></div></div><div class="table-responsive"><table><tbody>
<tr><td>14/07/2021</td><td>Legislative proposal published</td><td><a href="/doc/1"><span>COM(2021)0001</span></a></td><td><a href="/sum/1"><button>Summary</button></a></td></tr>
<tr><td>15/07/2022</td><td>Final act published in Official Journal</td><td><span>plain <a href="http://x/y">OJ L 1</a></span></td><td></td></tr></tbody></table></div></div>
<div><div><div><h2 class="es_title-h2 mb-2">Forecasts</h2></div></div><div class="table-responsive"><table><tbody><tr><td>01/12/2030</td><td>Vote in plenary</td></tr></tbody></table></div></div>
<div id="erplAccordionDocGateway"><ul><li><button><span class="t-x">European Parliament</span></button><div class="table-responsive"><table><tbody>
<tr><td>Committee draft report</td><td>ENVI</td><td><a href="http://d/1">PE1</a></td><td>02/03/2021</td><td></td></tr></tbody></table></div></li>
<li><button><span class="t-x">European Commission</span></button><div class="table-responsive"><table><tbody>
<tr><td>Legislative proposal</td><td><a href="http://h/doc/1">COM(2021)0001</a></td><td>14/07/2021</td><td><a href="/sum/1"><button>Summary</button></a></td></tr>
<tr><td>Follow-up document</td><td><a href="http://d/2">COM(2022)0002</a></td><td>14/07/2022</td><td></td></tr></tbody></table></div></li></ul></div>
<div><div><h2 class="es_title-h2 mb-2">Final act</h2></div></div><div><ul><li><a href="/act/1">Regulation 1</a><a href="/act/2">OJ 1</a> <a href="/sum/9"><button>Summary</button></a></li></ul></div>
</body></html>"""


def test_dossier_page():
    doc = dossier_page.dossier(PAGE, "http://h/p", {"Legislative proposal published": "EC"}, {"ENVI": "Environment"})
    assert doc["procedure"] == {"reference": "2021/0001(COD)", "title": "A title & more", "final": {"title": "Regulation 1", "url": "http://h/act/1"}}
    assert doc["council"] == [{"body": "CSL", "type": "Council Meeting", "council": "Environment", "meeting_id": "3765", "url": "http://m/3", "date": "2021-02-01T00:00:00"}]
    assert doc["commission"] == [{"body": "EC", "dg": "Climate Action", "commissioner": "NAME Some"}]
    first, last = doc["events"]
    assert first == {"date": "2021-07-14T00:00:00", "type": "Legislative proposal published", "body": "EC", "docs": [{"url": "http://h/doc/1", "title": "COM(2021)0001"}], "summary": ["http://h/sum/1"]}
    assert last["docs"][:2] == [{"url": "http://x/y", "title": "OJ L 1"}, {"title": "plain"}] and last["summary"] == ["http://h/sum/9"] and len(last["docs"]) == 4
    assert doc["forecasts"] == [{"date": "2030-12-01T00:00:00", "title": "Vote in plenary"}]
    assert [(d["type"], d["body"], d.get("committee")) for d in doc["docs"]] == [("Committee draft report", "European Parliament", "ENVI"), ("Follow-up document", "European Commission", None)]


def test_bad_pages(spark):
    missing = '<span class="ep_name">This procedure or document does not exist!</span>'
    broken = PAGE.replace("<td>Vote in plenary</td>", "")
    with pytest.raises(dossier_page.BadPage):
        dossier_page.dossier(broken, "u", {}, {"ENVI": ""})
    rows = spark.createDataFrame([("http://h/p", PAGE), ("http://h/q", missing), ("http://h/r", broken), ("http://h/s", None)], "url string, html string")
    got = {r.url[-1]: r for r in dossier_page.dossiers(rows, {}, {"ENVI": "x"}).collect()}
    assert json.loads(got["p"].doc)["procedure"]["reference"] == "2021/0001(COD)" and got["q"].error == "no such procedure"
    assert "forecast" in got["r"].error and got["s"].doc is None and got["s"].error


def test_dom():
    root = dom.parse("<div class='a b'>x <b>y</b><br>z</div><p>q")
    div = root.all("div")[0]
    assert div.text == "x yz" and div.own_text == "x z" and div.classes == ["a", "b"] and div.next().text == "q" and div.all("b")[0].up(2) is root


def test_reference_block():
    people = {"Ann A": 1, "Bob B": 2}
    names = lambda s: s.split(", ")
    block = ["Motion for a resolution B9-0123/2021", "Ann A, Bob B, Who", "Something on", "2020/2100(INL) and 2020/2121(INL)"]
    got = at.reference_block(block, people.get, names, lambda r: r == "2020/2121(INI)")
    assert got == {"type": "Motion for a resolution", "aref": "B9-0123/2021", "meps": [1, 2], "dossier": "2020/2121(INL)"}
    assert "dossier" not in at.reference_block(block, people.get, names, lambda r: False)
    assert at.reference_block([*block[:3], "2020/2121(INI)"], people.get, names, lambda r: False)["dossier"] == "2020/2121(INI)"
    assert at.reference_block(["no number"], people.get, names, bool) is None and at.reference_block(block[:1], people.get, names, bool) == {"type": "Motion for a resolution", "aref": "B9-0123/2021"}


def test_cover():
    dossier = {
        "procedure": {"title": "On things"}, "committees": [{"type": "Responsible Committee", "rapporteur": [{"name": "Ann A", "group": "Greens Group", "abbr": "Greens", "mepref": 1}, {"name": "Bob B", "group": "S Group", "abbr": "S&D", "mepref": 2}]}],
        "events": [{"type": "Legislative proposal published", "docs": [{"title": "COM(2021)0001"}]}],
    }
    member = {1: {"sur": "Ann", "family": "A"}, 2: {"sur": "Bob", "family": "B"}}.__getitem__
    lines = ["____", "Amendments 1-12", "by the Committee on the Environment", "Report", "Bob B (S&D), Ann A (Greens)", "On things", "(COM(2021)0001 – C9-0001/2021 – 2021/0001(COD))", "left over", ""]
    found, left = at.cover(lines, "2021/0001(COD)", dossier, "A9-0001/2021", member, {"Committee on the Environment": "ENVI"})
    assert found == {"committee": "ENVI"} and left == ["left over"]


def test_comment_and_gutter():
    block = [
        "Text proposed by the Commission                Amendment", "old text is here                               new text is here", "and goes on here                               and goes on too",
        "", "(This amendment applies throughout the text. Adopting it will need more changes.)", "", " " * 70 + "Or. en",
    ]
    language, comment, left = at.comment(block, 80, 0)
    assert language == "en" and comment == [block[4]] and left == [*block[:4], ""]
    assert at.comment(["Amendment 1", "plain end"], 80, 0)[1] is None
    assert at.gutter(["ab      cd", "a       d"], 5) == (2, 7) and at.gutter([], 5) is None and at.gutter(["x" * 60], 5) is None


def test_blocks_of_lines(spark):
    df = spark.createDataFrame([(["", " ", "a", "", "b", " "],), (["", " "],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in df.select(at.without_blank_ends(F.col("l"))).collect()][:3] == [["a", "", "b"], [], []]
    assert at.stripped(["", " ", "a", "", "b", " "]) == ["a", "", "b"] and at.stripped([" "]) == []
    rows = spark.createDataFrame([("  motion for  a Resolution on x",), ("PE123.456v01-00",), ("AM\\12.doc",), (None,)], "t string")
    got = rows.select(at.begins_with(F.col("t"), ["Motion for a resolution"]).alias("k"), at.is_page_line(F.col("t"), ["AM\\"], [r"PE\d{3}\.\d{3}"]).alias("p")).collect()
    assert [r.k for r in got][:2] == [True, False] and [r.p for r in got] == [False, True, True, False]


def test_html_amendments():
    table = '<div class="table-responsive"><table><tr><td></td><td></td></tr><tr><td>Text proposed by the Commission</td><td>Amendment</td></tr><tr><td>old a</td><td>new a</td></tr><tr><td>old b</td><td>new b</td></tr></table></div>'
    head = lambda n: f"<p><span>Amendment</span><span>{n}</span></p>"
    page = (
        f"<body>{head(1)}<p></p><p>Proposal for a regulation</p><p>Article 1 – title</p><p>paragraph 2</p>{table}<p>Because.</p><p></p><p>So.</p>"
        f"{head(2)}<p>Compromise A</p><p>Proposal for a regulation</p><p>Recital 3</p><p>Text proposed by the Commission</p><p>was</p><p>Amendment</p><p>is</p><p>Justification</p><p>why</p>"
        f"{head(3)}<p>Nothing known</p>{head(4)}</body>"
    )
    got = at.html_amendments(page, {"Proposal for a regulation"}, {"Article", "Recital"}, skipped={"4"})
    assert got == [
        {"seq": "1", "location": ["Article 1 – title", "paragraph 2"], "old": ["old a", "old b"], "new": ["new a", "new b"], "justification": "Because.\nSo."},
        {"seq": "2", "compromise": "A", "location": ["Recital 3"], "old": ["was"], "new": ["is"], "justification": ["why"]}, {"seq": "4"},
    ]
