import datetime
import hashlib
import re

from pyspark.sql import functions as F

from quaestor.llm import pii


def digest(kind, size, turn, half):
    return hashlib.sha512(f"quaestor|{kind}|{size}|{turn}|{half}".encode()).hexdigest()


def feistel(value, kind, alphabet=None):
    n = len(value)
    l, r = value[: n // 2], value[n // 2 :]
    for i in range(1, 9):
        h, out = digest(kind, n, i, r), ""
        for j, c in enumerate(l):
            k = int(h[j % 42 * 3 : j % 42 * 3 + 3], 16)
            for a in [alphabet] if alphabet else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]:
                if c in a:
                    c = a[(a.index(c) + k) % len(a)]
                    break
            out += c
        l, r = r, out
    return l + r


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10


CARD = "4539578763621486"
CASES = [
    CARD, "4539 5787 6362 1486", "4539578763621487", "+1 (017) 555-7713", "und.34@mail7.example.com", "a@b.io", "97.51.17.173",
    "300.1.1.1", "2024-02-29", "2023-02-29", "31/12/1999", "01.02.2003", "123-45-6789", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01",
    "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B",
]


def images(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", pii.kind(F.col("v")).alias("k"), pii.pseudonym(F.col("v")).alias("p")).collect()
    return {r.v: (r.k, r.p) for r in got}


def test_each_kind_keeps_its_format_and_validity(spark):
    got = images(spark, CASES)
    for v, (k, p) in got.items():
        if k in ("ip", "date"):
            continue
        assert re.sub(r"[0-9]", "9", v) == re.sub(r"[0-9]", "9", p) or k in ("token", "iban", "email"), (v, p)
    assert {v for v, (k, p) in got.items() if k is None} == {"4539578763621487", "300.1.1.1", "2023-02-29", "DE89 3704 0044 0532 0130 01"}
    assert all((p == v) == (k is None) for v, (k, p) in got.items())
    body = feistel(CARD[:-1], "card")
    assert got[CARD][1][:-1] == body and luhn(got[CARD][1]) == 0
    assert got["4539 5787 6362 1486"][1].replace(" ", "") == got[CARD][1]
    assert got["und.34@mail7.example.com"][1] == feistel("und.34", "email") + "@mail7.example.com"
    token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    assert got[token][1] == feistel(token, "token", "0123456789abcdef")
    assert got["+1 (017) 555-7713"][1].startswith("+1 (")
    datetime.date.fromisoformat(got["2024-02-29"][1])
    datetime.datetime.strptime(got["31/12/1999"][1], "%d/%m/%Y")
    assert all(int(o) < 256 for o in got["97.51.17.173"][1].split("."))
    iban = got["DE89 3704 0044 0532 0130 00"][1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE"


def test_permutations_are_one_to_one(spark):
    days = [str(datetime.date(2000, 1, 1) + datetime.timedelta(i)) for i in range(2000)]
    numbers = [f"123-45-{i:04d}" for i in range(2000)]
    got = images(spark, days + numbers)
    assert len({p for _, p in got.values()}) == 4000


def test_texts(spark):
    rows = [
        (1, f"pay {CARD} now\nor {CARD}.", "x"), (2, f"{CARD}", None), (3, None, "x"), (4, "", "x"), (5, "nothing 4539578763621487 here, v 2.0.", "x"),
        (6, "word " * 50000 + "me@x.org", "x"), (None, "und.34@mail7.example.com###", "x"), (1, f"pay {CARD} now\nor {CARD}.", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = pii.pseudonymised(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    c = images(spark, [CARD, "und.34@mail7.example.com"])
    assert (1, f"pay {c[CARD][1]} now\nor {c[CARD][1]}.") in got and got.count(got[0]) == 2
    assert (2, c[CARD][1]) in got and (3, None) in got and (4, "") in got and (5, rows[4][1]) in got
    assert (None, c["und.34@mail7.example.com"][1] + "###") in got
    long = next(t for i, t in got if i == 6)
    assert long.startswith("word " * 50000) and "me@x.org" not in long
    seen = {(r.id, r.kind, r.n) for r in pii.findings(df).collect()}
    assert (1, "card", 4) in seen and (2, "card", 1) in seen and (5, "card", 1) not in seen
    assert pii.pseudonymised(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = pii.pseudonymised(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_valid_values_before_and_after_other_characters(spark):
    visa, be, es = "4111 1111 1111 1111", "BE68 5390 0754 7034", "ES9121000418450200051332"
    hex32 = "AB12" + "CD34" * 7
    c = {v: p for v, (_, p) in images(spark, [visa, be, es, hex32, "97.51.17.173", "123-45-6789", CARD, "2024-02-29"]).items()}
    cases = [f"{visa} 123", f"{visa} 12/27", f"{visa}-1 x", f"12 {visa} 7", f"{visa} 97.51.17.173", f"{visa} 123-45-6789", f"é {visa} {CARD}", f"2024-02-29 {visa}"]
    cases += [f"{es} BIC", f"{be} BIC", f"{be} BANK OF X", f"{be} 12", f"IBAN {be}", f"{hex32} BIC", f"{es} {be}"]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymised(rows).collect()}
    for i, text in enumerate(cases):
        for v, p in c.items():
            text = text.replace(v, p)
        assert got[i] == text and got[i] != cases[i], cases[i]
    assert {(r.id, r.value) for r in pii.findings(rows).collect()} == {(i, v) for i, t in enumerate(cases) for v in c if v in t}


def test_dates_with_the_month_first(spark):
    days = [d for n in range(1500) if (d := datetime.date(2001, 1, 1) + datetime.timedelta(n)).day > 12]
    got = images(spark, [d.strftime(f) for d in days for f in ("%m/%d/%Y", "%d/%m/%Y", "%m.%d.%Y")])
    assert {k for k, _ in got.values()} == {"date"} and len({p for _, p in got.values()}) == len(got) == 3 * len(days)
    for d in days:
        datetime.datetime.strptime(got[d.strftime("%m/%d/%Y")][1], "%m/%d/%Y")


def test_equal_values_are_linked_however_they_are_written(spark):
    same = [["+49 30 1234567", "+49 301234567", "+4930 1234567", "+49-30-123-4567"], ["(555) 123-4567", "555-123-4567", "555.123.4567", "+1 555 123 4567"], ["192.168.1.10", "192.168.001.010"], ["2001:db8::1:ff", "2001:0DB8:0:0:0:0:1:ff"]]
    got = images(spark, [v for vs in same for v in vs] + ["1" * 32, "AKIA" + "AB12" * 4, "sk_live_abcDEF0123456789", "a::b", "12:34:56", "::1", "12/31/1999"])
    digits = lambda v: re.sub(r"[^0-9]", "", v)
    assert len({digits(got[v][1]) for v in same[0]}) == 1 and digits(got[same[0][0]][1]).startswith("49") and all(got[v][0] == "phone" for v in same[0] + same[1])
    assert len({digits(got[v][1])[-10:] for v in same[1]}) == 1 and got["(555) 123-4567"][1][0] == "("
    a, b = (got[v][1] for v in same[2])
    assert [int(x) for x in a.split(".")] == [int(x) for x in b.split(".")] and [len(x) for x in b.split(".")][2:] == [3, 3]
    a, b = (got[v][1] for v in same[3])
    assert a.lower() == b.lower() and re.fullmatch("(?:[0-9a-f]{4}:){7}[0-9a-f]{4}", a) and got["2001:db8::1:ff"][0] == "ipv6"
    assert re.fullmatch("[0-9]{32}", got["1" * 32][1]) and re.fullmatch("AKIA(?:[A-Z]{2}[0-9]{2}){4}", got["AKIA" + "AB12" * 4][1])
    assert re.fullmatch("sk_live_[a-z]{3}[A-Z]{3}[0-9]{10}", got["sk_live_abcDEF0123456789"][1])
    assert all(got[v] == (None, v) for v in ("a::b", "12:34:56", "::1")) and got["12/31/1999"][0] == "date"
    addresses = [f"10.0.{i // 250}.{i % 250}" for i in range(1500)]
    assert len({p for _, p in images(spark, addresses).values()}) == 1500


def test_new_kinds_in_texts(spark):
    values = ["(555) 123-4567", "555-123-4567", "AKIA" + "AB12" * 4, "2001:db8::1:ff", "+4930 1234567"]
    rows = [(i, f"see {v}, or ({v}).") for i, v in enumerate(values)] + [(9, "std::vector<a::b> at 10:20:30, version 1.2.3-4, 555-12-34567, 2020-555-123-4567")]
    got = {r.doc_id: r.text for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    images_ = {v: p for v, (_, p) in images(spark, values).items()}
    for i, v in enumerate(values):
        assert got[i] == f"see {images_[v]}, or ({images_[v]})." != rows[i][1]
    assert got[9] == rows[5][1]


def test_the_key_comes_from_the_session(spark):
    df = spark.createDataFrame([(1, CARD)], "doc_id long, text string")
    one = pii.pseudonymised(df).first().text
    spark.conf.set("spark.quaestor.pii.key", "another")
    try:
        assert one != pii.pseudonymised(df).first().text == pii.pseudonymised(df, key="another").first().text
    finally:
        spark.conf.unset("spark.quaestor.pii.key")
