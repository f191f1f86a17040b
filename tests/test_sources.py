import pytest

from quaestor.sources import files, framed, parsers


def test_framed_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b\nc")], "id int, v string")
    framed.write(df, f"{tmp_path}/t.json")
    assert framed.read(spark, f"{tmp_path}/t.json").count() == 2
    framed.write(df.limit(0), f"{tmp_path}/t.json")
    assert framed.read(spark, f"{tmp_path}/t.json").count() == 0
    (tmp_path / "u.json").write_text('[{"id": 1, "v": "a"}\n,{"id": 1, "v": "b"}\n,{"id": 2, "v": null}\n]')
    got = framed.read_table(spark, f"{tmp_path}/u.json", "id", "id int, v string").collect()
    assert sorted((r.id, r.v) for r in got if r.id == 1) == [(1, "b")] and len(got) == 2
    assert framed.read_table(spark, f"{tmp_path}/missing.json", "id", "id int, v string").count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "a,b"), (1, "c")], "n int, v string")
    files.write_csv(df, f"{tmp_path}/c")
    assert {r.v for r in files.read_csv(spark, f"{tmp_path}/c").collect()} == {"a b", "c"}
    for date in ("20200101", "20200102", "20200103", "20200104"):
        (tmp_path / "arch").mkdir(exist_ok=True)
        (tmp_path / "arch" / f"t-{date}").write_text("x")
    assert {r.date for r in files.archive(spark, f"file://{tmp_path}/arch").collect()} == {"20200102", "20200103", "20200104"}
    assert files.calendar(spark, "2019-11-01", "2020-02-01", ["A", "B"]).count() == 8
    page = '{"references":[{"reference":"r","fragments":[{"name":"RCV","versions":[{"language":"EN","fileInfos":[{"typeDoc":"text/xml","url":"u"},{"typeDoc":"pdf","url":"p"}]}]}]}]}'
    assert [r.url for r in files.paged(spark.createDataFrame([(page,), (page,)], "doc string"), "doc").collect()] == ["u"]
    seen = spark.createDataFrame([("2020/1*II",), ("2020/2",)], "ref string")
    assert [r.ref for r in files.unknown(seen, spark.createDataFrame([("2020/1",)], "ref string"), "ref", "*").collect()] == ["2020/2"]


def test_pages_of_text():
    pages = [["Head", "  one", "  two", "PE 123", "foot"], ["Head", "  three", "PE 124", "foot"]]
    assert parsers.common_edges(pages) == (1, 1)
    assert parsers.unpaginated(pages) == ["one", "two", "three"]
    lines = ["left text      right words", "more           and more", "               only right"]
    assert parsers.two_columns(lines) == (["left text", "more"], ["right words", "and more", "only right"])
    assert parsers.fixed_width(["a b" + " " * 12 + "c"]) == [["a b", "c"]]
    assert parsers.marked_column("           X", "1-499      500-1000") == 1
    assert parsers.form_sections(["(A) first", "x", "(C) not next", "(B) second"]) == {"A": ["first", "x", "(C) not next"], "B": ["second"]}


def test_running_document():
    got = parsers.located(["Title", "A. one", "AA. more", "1. first", "text", "2a. second"])
    assert [g[:2] for g in got] == [("title", 0.0), ("consideration", 1), ("consideration", 27), ("paragraph", 1.0), ("paragraph", 1.0), ("paragraph", 2.01)]
    with pytest.raises(ValueError):
        parsers.located(["2. two", "1. one"])
    assert parsers.roman_number("xiv") == 14


def test_amendments(spark):
    body = ["preface", "Amendment 1", "Ann Other", "Article 1", "Text proposed        Amendment", "old words            new words", "Justification", "Because.", "Or. en", "Amendment 2", "B", "Article 2", "new only"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(body)], "doc string, pos int, line string")
    got = {r.seq: r for r in parsers.amendments(df, "doc", "pos", "line").collect()}
    assert got["1"].old == ["old words"] and got["1"].new == ["new words"] and got["1"].justification == "Because." and got["1"].orig_lang == "en" and got["1"].location == "Article 1"
    assert got["2"].new == ["new only"] and got["2"].authors == "B"


def test_votes(spark):
    xml = """<Votes><RollCallVote.Result Identifier="7" Date="2020-01-01 10:00:00"><RollCallVote.Description.Text>A <b>x</b></RollCallVote.Description.Text>
<Result.For Number="2"><Result.PoliticalGroup.List Identifier="G1"><PoliticalGroup.Member.Name MepId="5" PersId="55">Ann</PoliticalGroup.Member.Name><PoliticalGroup.Member.Name MepId="6">Bob</PoliticalGroup.Member.Name></Result.PoliticalGroup.List></Result.For></RollCallVote.Result></Votes>"""
    got = parsers.ballots(spark.createDataFrame([(xml,), (None,)], "xml string")).collect()
    assert sorted((r.voteid, r.sign, r.grp, r.mepid or 0, r.name, r.obscure_id) for r in got) == [("7", "+", "G1", 0, "Bob", 6), ("7", "+", "G1", 55, "Ann", 5)]
    assert parsers.committee_vote([("2", "+"), ("G1", "A, B"), ("1", "-"), ("G2", "C")])["+"] == {"total": 2, "groups": {"G1": ["A", "B"]}}
    assert parsers.member_ids("<m><x><id>3</id></x><id>3</id><id>4</id></m>") == [3, 4]


def test_json():
    assert parsers.cleaned({"a": None, "b": "", "c": 0, "documentLinks": [1], "d": {"date": 0}, "e": [{"x": ""}]}) == {"c": 0, "d": {"date": "1970-01-01T00:00:00"}, "e": [{}]}
