from pyspark.sql import functions as F

from quaestor.cdc import render
from quaestor.cdc.diff import diff
from quaestor.functions import text
from quaestor.operators import subs

FOUND = diff({"a": {"b": 1}, "l": [{"x": 1, "y": 2}]}, {"a": {"b": 2}, "l": [{"x": 1, "y": 3}], "n": "<new>"})


def test_text():
    assert render.lines(FOUND) == ["changed a.b: 1 -> 2", "changed l.0.y: 2 -> 3", "added n: <new>"]
    assert render.nested_lines(FOUND)[:3] == ["a:", "  b:", "    ~ 1 -> 2"]
    assert "<ins>&lt;new&gt;</ins>" in render.as_html(FOUND)
    value, log = render.value_and_changes({"a": {"b": 2}, "changes": {"t1": FOUND}}, ["a"])
    assert value == {"b": 2} and len(log) == 1


def test_history_rows(spark):
    changes = "map<string,array<struct<type:string,path:array<string>,data:string>>>"
    log = {"t1": [("changed", ["Name", "full"], '["Old N","New N"]'), ("added", ["l", "#0", "Y"], "1"), ("added", ["l", "#1", "Y"], "1")]}
    df = spark.createDataFrame([(1, log, (["New N"],))], f"UserID long, changes {changes}, Name struct<aliases:array<string>>")
    history = render.exploded(df, "UserID")
    assert history.count() == 3 and render.under(history, ["l"]).count() == 2 and render.under(history, []).count() == 3
    assert render.summaries(history).first().summary == "Name.full, l.Y"
    assert [r.path for r in render.filter_options(history).collect()] == ["l.Y", "Name.full"]
    assert render.aliases_from_history(df, history).first().aliases == ["New N", "Old N"]


def test_more_scalars(spark):
    got = spark.range(1).select(
        text.document_number(F.lit("x/PE-123.456v01")).alias("a"), text.document_number(F.lit("PE123456_EN")).alias("b"), text.document_reference(F.lit("doc/A-9-2020-0001_EN.html")).alias("c"),
        text.document_reference(F.lit("RC-9-2020-0002_EN")).alias("d"), text.phone(F.lit("0(0)32 2 28")).alias("e"), text.zip_city(F.lit("B-1047 Brussels")).alias("f"),
        text.link(F.lit(None).cast("string"), F.lit("/x")).alias("g"), text.row_number_stripped(F.lit("1. Name")).alias("h"), F.length(text.token()).alias("i"),
    ).first()
    assert tuple(got)[:5] == ("PE123.456", "PE123.456", "A9-0001/2020", "RC-B9-0002/2020", "+32 2 28")
    assert tuple(got.f) == ("B-1047", "Brussels") and got.g == '<a href="/x">Unknown</a>' and got.h == "Name" and got.i == 40


def test_notices(spark):
    items = spark.createDataFrame([("a", "dossier", 1, None), ("b", "dossier", 1, "p"), ("c", "dossier", 2, None)], "name string, type string, group_id int, activation_key string")
    assert sorted((r.state, r.names) for r in subs.group_page(items, 1).collect()) == [("active", ["a"]), ("pending", ["b"])]
    mails = subs.notices(spark.createDataFrame([("k", "m@x")], "key string, email string"), spark.createDataFrame([("k", "T", "B")], "key string, title string, body string"))
    assert tuple(mails.first()) == ("m@x", "k T", "B")
