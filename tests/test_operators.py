import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quaestor.functions import dates, text
from quaestor.operators import index, interval, logs, lookup, matrix, ordered, profile, resolve, rollup, search, similarity, subs
from quaestor.streaming.jobs import breaker_step


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_indexes(spark):
    df = spark.createDataFrame([(1, ["DE", "DE", None]), (2, None), (3, ["FR"])], "id int, c array<string>")
    assert rows(index.inverted_index(df, F.col("c")), "k", "id") == [("DE", 1), ("FR", 3)]
    assert rows(index.inverted_index(df, F.col("c"), distinct=False), "k", "id") == [("DE", 1), ("DE", 1), ("FR", 3)]
    assert len(rows(index.inverted_index(df, F.col("c"), keep_null=True), "k", "id")) == 4
    last = index.last_wins(spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "id int, v string, pos int"), ["id"], ["pos"])
    assert rows(last, "id", "v") == [(1, "b")]


def test_multi_get_keeps_order_and_misses(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [(r.pos, r.v) for r in lookup.multi_get(df, "k", [2, 9, 2]).orderBy("pos").collect()] == [(0, "b"), (1, None), (2, "b")]


def test_interval_ties_gaps_and_open_ends(spark):
    items = F.array(F.struct(F.lit("2020-01-01").alias("start"), F.lit("2020-06-01").alias("end"), F.lit("A").alias("v")), F.struct(F.lit("2020-06-01").alias("start"), F.lit("9999").alias("end"), F.lit("B").alias("v")))
    got = one(spark, a=interval.first_valid(items, F.lit("2020-06-01"))["v"], b=interval.first_valid(items, F.lit("2019-01-01")), c=interval.normal_end(F.lit(interval.OPEN), F.lit("2021-01-01")))
    assert (got.a, got.b, got.c) == ("A", None, "2021-01-01")


@pytest.mark.parametrize(
    "candidates, want",
    [
        ([(1, False, False, False, True)], 1),
        ([(1, True, True, True, False), (2, True, True, True, False)], None),
        ([(1, True, False, False, True), (2, False, False, False, True)], 1),
        ([(1, True, True, False, True), (2, True, False, False, True)], 1),
        ([(1, True, False, True, True), (2, True, False, False, True)], 1),
        ([(1, True, True, False, True), (2, True, True, False, True)], None),
        ([(1, False, True, True, True), (2, False, True, True, True)], None),
    ],
)
def test_resolution(spark, candidates, want):
    df = spark.createDataFrame([("p", *c) for c in candidates], "p string, e int, v boolean, g boolean, l boolean, d boolean")
    assert resolve.resolve(df, "p", "e", F.col("v"), F.col("g"), F.col("l"), F.col("d")).first().e == want


def test_matrix(spark):
    ballots = [("+", "G1", "DE"), ("+", "G1", "FR"), ("-", "G1", "DE"), ("-", "G2", "FR")]
    df = spark.createDataFrame(ballots, "sign string, g string, c string")
    got = {(r.level, r.g, r.c): (r.plus, r.minus, r.total) for r in matrix.marginals(df, "g", "c", F.col("sign")).collect()}
    assert got["cell", "G1", "DE"] == (1, 1, 2) and got["group", "G1", None] == (2, 1, 3) and got["country", None, "FR"] == (1, 1, 2) and got["vote", None, None] == (2, 2, 4)
    heat = matrix.heat(spark.createDataFrame([("v", 1), ("v", -2), ("v", 0), ("w", 3)], "v string, d int"), F.col("d"), ["v"])
    assert rows(heat, "v", "d", "heat") == [("v", -2, -7), ("v", 0, 0), ("v", 1, 4), ("w", 3, None)]


def test_cosine_and_cohesion(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 1.0), ("b", 2, 1.0), ("c", 1, 0.0)], "e string, d int, x double")
    got = {(r.a, r.b): (r.similarity and round(r.similarity, 6), r.n) for r in similarity.pairwise_cosine(df, "e", "d", "x").collect()}
    assert got == {("a", "b"): (0.707107, 2), ("a", "c"): (None, 1), ("b", "c"): (None, 1)}
    votes = spark.createDataFrame([("x", 1, s, i) for i, s in enumerate("++-00")], "e string, v int, s string, m int")
    assert similarity.cohesion(votes, ["e"], "v", F.col("s") == "+", F.col("s") == "-", "m").first().t == pytest.approx(0.2)


def test_toggle_breaker_islands(spark):
    marks = [("x", None), ("on", 1), ("y", None), ("z", None), ("off", 0), ("w", None)]
    df = spark.createDataFrame([(1, i, n, m) for i, (n, m) in enumerate(marks)], "k int, pos int, n string, m int")
    got = {r.n: r.state for r in ordered.toggle(df, ["k"], ["pos"], F.col("m")).collect()}
    assert (got["x"], got["y"], got["z"], got["w"]) == (0, 1, 1, 0)
    errors = spark.createDataFrame([(1, i, int(i < 10 or i == 45)) for i in range(60)], "k int, pos int, e int")
    tripped = [r.pos for r in ordered.sliding_errors(errors, ["k"], ["pos"], F.col("e")).where("tripped").collect()]
    assert tripped == [45, 46, 47, 48, 49]
    assert breaker_step([], 0, iter([True] * 10)) == ([1] * 10, 0, 10) and breaker_step([], 0, iter([True] * 11)) == ([], 1, 11)
    n = spark.createDataFrame([(1, i) for i in (1, 2, 3, 5, 7, 8)], "k int, n int")
    assert ordered.ranges(n, ["k"], "n").first().ranges == "1-3,5,7-8"


def test_search(spark):
    df = spark.createDataFrame([("Bar foo",), ("foo\nbar",), ("ÜBER (foo) bar",)], "t string")
    assert rows(df.where(search.has_terms(F.col("t"), "foo bar")), "t") == [("Bar foo",), ("ÜBER (foo) bar",)]
    assert rows(df.where(search.has_terms(F.col("t"), "über (foo)")), "t") == [("ÜBER (foo) bar",)]
    assert search.exact_or_pattern(df, F.col("t") == "Bar foo", F.lit(True)).count() == 1
    assert search.exact_or_pattern(df, F.lit(False), F.lit(True)).count() == 3


def test_profiles(spark):
    docs = [json.dumps(d) for d in ({"a": 1, "b": " ", "c": [1, 2, {"d": None}]}, {"a": "x", "c": []})]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = {(r.path, r.type): (r.n, r.percent) for r in profile.nested(df, "doc").collect()}
    assert got["a", "int"] == (1, 50.0) and got["a", "str"][0] == 1 and got["b", "null"][0] == 1 and got["c", "list"] == (2, 150.0) and got["c[].d", "null"][0] == 1
    flat = {(r.key, r.type): r.n for r in profile.flat(df, "doc").collect()}
    assert flat["b", "null"] == 1 and flat["a", "string"] == 1


def test_logs(spark):
    lines = ["2020-01-01T10:00:00 mep info added x", "  trailing line", "2020-01-01T10:00:01 mep error failed badly", "2020-01-01T10:00:01 other info no module", logs.TRACEBACK]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(lines)], "f int, pos int, value string")
    got = logs.assembled(logs.parsed(df, ["mep"]), ["f"], "pos").orderBy("record").collect()
    assert [(r.level, len(r.more)) for r in got] == [("info", 1), ("error", 2)]


def test_subscriptions(spark):
    changed = spark.createDataFrame([("d1", ["s1"], "Green\nfoo bar"), ("d2", [], "bar\nfoo")], "key string, subjects array<string>, title string")
    items = [("d1", "dossier", 1, None), ("s1", "subject", 2, ""), ("foo bar", "search", 3, None), ("d2", "dossier", 4, "pending")]
    people = [(1, "a", None), (2, "b", None), (3, "c", None), (4, "d", None), (1, "e", "pending")]
    got = subs.recipients(changed, spark.createDataFrame(items, "name string, type string, group_id int, activation_key string"), spark.createDataFrame(people, "group_id int, email string, activation_key string"), [F.col("title")])
    assert rows(got, "key", "email") == [("d1", "a"), ("d1", "b"), ("d1", "c")]


def test_subscriptions_send_only_the_counted_side(spark, tmp_path):
    table = [("d1", ["s1"], "Green\nfoo bar"), ("d2", ["s1", "s1"], "bar\nfoo"), ("d2", None, "x foo bar"), ("d3", [], None), (None, ["s2"], "a foo bar é")]
    spark.createDataFrame(table, "key string, subjects array<string>, title string").write.parquet(f"{tmp_path}/t")
    changed = spark.read.parquet(f"{tmp_path}/t")  # its size is known and small; that of the items isn't
    items = [("d1", "dossier", 1, None), ("s1", "subject", 2, ""), ("foo bar", "search", 3, None), ("É", "search", 4, None), ("fo x", "search", 1, ""), (" ", "search", 2, None), (None, "search", 2, None), ("d3", "dossier", 5, None)]
    items = spark.createDataFrame(items, "name string, type string, group_id int, activation_key string")
    people = spark.createDataFrame([(g, p, None) for g, p in ((1, "a"), (2, "b"), (3, "c"), (4, "d"), (3, "a"))], "group_id int, email string, activation_key string")
    want = [(None, "a"), (None, "c"), (None, "d"), ("d1", "a"), ("d1", "b"), ("d1", "c"), ("d2", "a"), ("d2", "b"), ("d2", "c")]
    for most in (100, 0):
        out = subs.recipients(changed, items, people, [F.col("title")], most=most)
        assert sorted(((r.key, r.email) for r in out.collect()), key=str) == sorted(want, key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 0)
    none = subs.recipients(changed, items.limit(0), people, [F.col("title")])
    assert none.count() == 0


def test_subscriptions_by_default_send_no_changed_rows(spark, tmp_path):
    spark.range(9).selectExpr("cast(id as string) key", "array('s') subjects", "'foo bar' title").write.parquet(f"{tmp_path}/t")
    items = spark.createDataFrame([("s", "subject", 1, None), ("foo", "search", 1, None)], "name string, type string, group_id int, activation_key string")
    people = spark.createDataFrame([(1, "a", None)], "group_id int, email string, activation_key string")
    out = subs.recipients(spark.read.parquet(f"{tmp_path}/t"), items, people, [F.col("title")])
    assert out.count() == 9 and "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()


def test_zip_stops_at_a_mismatch(spark):
    a = spark.createDataFrame([(1, i, s) for i, s in enumerate("abc")], "k int, pos int, x string")
    b = spark.createDataFrame([(1, i, s) for i, s in enumerate("axcd")], "k int, pos int, y string")
    pairs = rollup.zipped(a, b, ["k"])
    assert pairs.count() == 4
    assert rows(rollup.valid_prefix(pairs, ["k"], F.col("x") != F.col("y")), "pos") == [(0,)]


def test_scalars(spark):
    got = one(
        spark,
        size=text.human_size(F.lit(1536)), zero=text.human_size(F.lit(0)), names=text.split_names(F.lit("A B and C D on behalf of the X Group")),
        name=text.normalize_name(F.lit("Ünal  STRAßE")), basis=text.rewritten(F.array(F.lit("Treaty on the Functioning of the EU TFEU 114"))), aa=text.base26(F.lit("aa")),
        path=text.slice_path(F.lit("2019/0001(COD)")), mail=text.deobfuscated(F.lit("mailto:moc[dot]x[at]em")), iv=text.roman(F.lit("xiv")), slug=text.slug(F.lit("NA"), "i/", ".gif"),
        role=text.split_last(F.lit("A - B - Chair")), abbr=text.is_abbreviation(F.lit("A.B.")), ws=text.collapse(F.lit(" a \x1c b ")), mark=text.highlighted(F.lit("a <b> Foo"), "foo"),
        diff=text.word_diff(F.lit("a b"), F.lit("a c")), person=text.person_name(F.lit("Dr Anna Maria VON DER LEYEN")), norm=text.normalize_ascii(F.lit("A-1 é")),
    )
    assert (got.size, got.zero, got.names, got.name, got.basis) == ("1.5 KiB", "0.0 bytes", ["A B", "C D"], "unalstrasse", ["TFEU 114"])
    assert (got.aa, got.path, got.mail, got.iv, got.slug) == (27, "COD/2019/0001", "me@x.com", 14, "i/ni.gif")
    assert got.role == Row(head="A - B", last="Chair") and got.abbr and got.ws == "a b" and got.mark == "a &lt;b&gt; <span>Foo</span>"
    assert got.diff == "<span>a </span><del>b</del><ins>c</ins>" and (got.person.sur, got.person.family, got.person.title) == ("Anna Maria", "VON DER LEYEN", "Dr") and got.norm == "a1"


def test_dates(spark):
    same = [str(one(spark, d=dates.as_date(F.lit(t))).d) for t in ("03/04/2020", "2020-04-03", "2020/04/03", "03-04-2020")]
    assert same == ["2020-04-03"] * 4
    got = one(spark, bad=dates.as_date(F.lit("x")), none=dates.shown(F.lit("")), open=dates.shown(F.lit("9999-12-31T00:00:00")), term=dates.term(F.lit("2020-01-01")), two=dates.terms_of_year(F.lit(2019)), h=dates.history(F.lit("01-02-2010 / 03-04-2011")), o=dates.history(F.lit("01-02-2010 ...")))
    assert got.bad is None and got.none == "unknown date" and got.open == "" and got.term == 9 and got.two == [8, 9]
    assert got.h == Row(start="2010-02-01T00:00:00", end="2011-04-03T00:00:00") and got.o.end == "9999-12-31T00:00:00"


def test_random_interval_join_against_a_loop(spark):
    rnd = random.Random(1)
    spans = [(rnd.randrange(5), i, rnd.randrange(50), rnd.randrange(50)) for i in range(80)]
    probes = [(i, rnd.randrange(6), rnd.randrange(50)) for i in range(60)]
    right = spark.createDataFrame(spans, "k int, pos int, a int, z int")
    left = spark.createDataFrame(probes, "row int, k int, at int")
    got = {r.row: r.match and r.match.pos for r in interval.interval_join(left, right, "k", "at", "a", "z", "pos", period=lambda c: F.floor(c / 10)).collect()}
    assert got == {i: min((p for kk, p, a, z in spans if kk == k and a <= at <= z), default=None) for i, k, at in probes}


def test_interval_join_on_a_hot_key_over_years_with_open_ends_and_nulls(spark):
    days = [f"{y}-{m:02d}-15" for y in range(2015, 2022) for m in range(1, 13)]
    spans = [(1, i, days[i], "9999-12-31" if i % 9 == 0 else days[min(i + i % 30, len(days) - 1)]) for i in range(len(days))] + [(1, 900, None, "2020-01-01"), (2, 901, "1901-01-01", None)]
    probes = [(i, 1, d) for i, d in enumerate([*days, "2014-12-31", "2022-01-01", None])] + [(900, 2, "2020-01-01"), (901, None, "2020-01-01")]
    right = spark.createDataFrame(spans, "k int, pos int, a string, z string").select("k", "pos", F.to_date("a").alias("a"), F.to_date("z").alias("z"))
    left = spark.createDataFrame(probes, "row int, k int, at string").withColumn("at", F.to_date("at"))
    got = {r.row: r.match and r.match.pos for r in interval.interval_join(left, right, "k", "at", "a", "z", "pos").collect()}
    assert got == {i: min((p for kk, p, a, z in spans if kk == k and a and z and d and a <= d <= z), default=None) for i, k, d in probes}
    assert interval.interval_join(left.limit(0), right, "k", "at", "a", "z", "pos").count() == 0
    assert interval.interval_join(left, right.limit(0), "k", "at", "a", "z", "pos").where("match is null").count() == len(probes)
