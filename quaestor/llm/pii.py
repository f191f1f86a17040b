"""PII as format-preserving pseudonyms, in Spark SQL expressions only.

One regular expression finds the longest candidate at every place; each kind is validated (Luhn, mod 97, octets,
calendar). Where a card, IBAN or phone number isn't valid as a whole, its longest valid part from the same start to a
separator counts, an IBAN of its country's length before others; values don't overlap, the first from the left counts. A value
that passes is replaced by its image under a keyed Feistel permutation of its format: digits become
digits, letters letters, separators stay. Rounds take SHA-512 of key, kind, length, round and one half, and shift each character of
the other half within its alphabet, so that the map is a bijection and equal values get equal pseudonyms in every document.

kind   candidate                         permuted                                   stays valid by
card   13 to 19 digits, Luhn-valid       all digits but the last                    a new Luhn digit
iban   country, 2 digits, 11 to 30 more  the account part                           new check digits
ip     four octets up to 255             the 32 bits, in hexadecimal                construction; leading zeros stay
ipv6   eight groups, or :: in 3 to 7     the 128 bits, in hexadecimal               construction, in eight groups
date   y-m-d, d/m/y, d.m.y, 1900-2099;   the day's number in those 200 years;       construction
       m/d/y, m.d.y if the day is over 12  days over 12 among themselves
phone  + or 00, country, groups;         the digits after the country's, however    pattern
       (ddd) ddd-dddd, ddd-ddd-dddd      they are grouped
ssn    3-2-4 digits                      all digits                                 pattern
email  local@host                        letters and digits of the local part       pattern
token  32 or more hexadecimal digits     the hexadecimal digits; only digits among  pattern
                                         themselves
key    access keys by their prefixes     letters and digits after the prefix        pattern

Equal values get equal pseudonyms whatever their separators. The key is a parameter; else it is the session's
spark.quaestor.pii.key or the variable QUAESTOR_PII_KEY. Without one the published default is used, with a warning:
whoever knows the key can invert the pseudonyms."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "quaestor"
ROUNDS = 8

# The kinds' patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,64})(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "ipv6": r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![A-Za-z0-9:]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+|00)[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\([2-9][0-9]{2}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![.-])[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}(?![.-][0-9]))(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
}
# Country calling codes of one and of two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
PATTERN = "|".join(PATTERNS.values())
PLACES = f"(?=({PATTERN}))"
IBAN_SIZES = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
        "HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
        "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_FIRST, _DAYS_L, _DAYS_R = "1900-01-01", 17, 4297  # 17 * 4297 days are the years 1900 to 2099


def _mix(kind: str, key: str, size: Column, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), size.cast("string"), turn.cast("string"), half), 512)


def _number(digest: Column, at: Column) -> Column:
    """A number under 4096 from three hexadecimal digits of a digest."""
    return F.conv(F.substr(digest, at % 42 * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _turned(c: Column, k: Column) -> Column:
    """A character moved k places within its alphabet; others stay."""
    code = F.ascii(c)

    def within(first: str, n: int) -> Column:
        return F.chr(F.lit(ord(first)) + (code - ord(first) + k) % n)

    return (
        F.when(c.between("0", "9"), within("0", 10))
        .when(c.between("a", "z"), within("a", 26))
        .when(c.between("A", "Z"), within("A", 26))
        .otherwise(c)
    )


def feistel(value: Column, kind: str, key: str = KEY, alphabet: str | None = None) -> Column:
    """The image of a string under the keyed permutation of its format. alphabet: 16 characters for
    hexadecimal digits of one case; else digits, a-z and A-Z move within themselves."""
    size = F.length(value)
    left = F.substr(value, F.lit(1), F.floor(size / 2).cast("int"))
    right = F.substr(value, F.floor(size / 2).cast("int") + 1, size)

    def moved(text: Column, digest: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            k = _number(digest, j)
            if alphabet:
                return F.substr(F.lit(alphabet), (F.instr(F.lit(alphabet), c) - 1 + k) % 16 + 1, F.lit(1))
            return _turned(c, k)

        return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s.r.alias("l"), moved(s.l, _mix(kind, key, size, i, s.r)).alias("r"))

    start = F.struct(left.alias("l"), right.alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s.l, s.r))


def _day(n: Column, key: str) -> Column:
    """The image of a day's number under the keyed permutation of the 200 years."""

    def shift(i: Column, half: Column, modulus: int) -> Column:
        return F.conv(F.substr(_mix("date", key, F.lit(modulus), i, half.cast("string")), F.lit(1), F.lit(7)), 16, 10).cast("int") % modulus

    def turn(s: Column, i: Column) -> Column:
        l = (s.l + shift(i, s.r, _DAYS_L)) % _DAYS_L
        return F.struct(l.alias("l"), ((s.r + shift(i, l, _DAYS_R)) % _DAYS_R).alias("r"))

    start = F.struct(F.floor(n / _DAYS_R).cast("int").alias("l"), (n % _DAYS_R).cast("int").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s.l * _DAYS_R + s.r)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one not doubled."""

    def value(c: Column, i: Column) -> Column:
        v = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, v: a + v)


def _mod97(text: Column) -> Column:
    def step(a: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _laid(pattern: Column, value: Column, placeholder: str) -> Column:
    """value's characters put where the pattern has a character of the class, all else as in the pattern."""

    def one(c: Column, j: Column) -> Column:
        at = F.length(F.regexp_replace(F.substr(pattern, F.lit(1), j + 1), f"[^{placeholder}]", ""))
        return F.when(c.rlike(f"[{placeholder}]"), F.substr(value, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(pattern, ""), one), "")


def _only(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[^{characters}]", "")


def kind(match: Column) -> Column:
    """The kind of a match of PATTERN if it is valid, else null."""
    digits, plain = _only(match, "0-9"), _only(match, "A-Z0-9")
    octets = F.split(match, r"\.")
    date = _date(match)
    whole = {k: "^(?:" + _core(p) + ")$" for k, p in PATTERNS.items()}
    size = F.length(digits)
    return (
        F.when(F.instr(match, "@") > 0, "email")
        .when(match.rlike(whole["token"]), "token")
        .when(match.rlike(whole["iban"]) & F.length(plain).between(15, 34), F.when(_mod97(F.concat(F.substr(plain, F.lit(5), F.lit(40)), F.substr(plain, F.lit(1), F.lit(4)))) == 1, "iban"))
        .when(match.rlike(whole["ip"]), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(match.rlike(whole["key"]), "key")
        .when(match.rlike(whole["ipv6"]), F.when((F.instr(match, "::") == 0) | (F.size(_groups(match)).between(3, 7) & match.rlike("[0-9]")), "ipv6"))
        .when(match.rlike(whole["date"]), F.when(date.between(F.lit(_FIRST).cast("date"), F.lit("2099-12-31").cast("date")), "date"))
        .when(match.rlike(whole["phone"]), F.when(size.between(8, 17), "phone"))
        .when(match.rlike(whole["ssn"]), "ssn")
        .when(match.rlike(whole["card"]), F.when((_luhn(digits) % 10 == 0) & (digits.rlike("[^0]")), "card"))
    )


def _core(pattern: str) -> str:
    """A pattern without its look-behind and look-ahead."""
    head = pattern.index(")") + 1
    return pattern[head : pattern.rindex("(?!")]


def _groups(address: Column) -> Column:
    """The written groups of an address with colons."""
    return F.filter(F.split(address, ":"), lambda g: g != "")


def _bits(address: Column) -> Column:
    """An address's 32 hexadecimal digits, :: filled with zeros."""
    left, right = _groups(F.substring_index(address, "::", 1)), _groups(F.when(F.instr(address, "::") > 0, F.substring_index(address, "::", -1)).otherwise(""))
    zeros = F.array_repeat(F.lit("0000"), 8 - F.size(left) - F.size(right))
    full = F.concat(left, zeros, right)
    return F.lower(F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def _date(match: Column) -> Column:
    return F.coalesce(*(F.try_to_date(match, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "MM.dd.yyyy")))


def _month_first(match: Column) -> Column:
    """Whether a date can only be read month first."""
    return match.rlike(r"^[0-9]{2}[/.](?:1[3-9]|[23][0-9])[/.]")


def _late_day(n: Column, key: str) -> Column:
    """The image of a day's number among the days over 12 of a month: the permutation is applied till it gives one.
    Six tenths of the days are, so 100 turns are never used up."""
    late = lambda x: F.dayofmonth(F.date_add(F.lit(_FIRST).cast("date"), x)) > 12

    def turn(x: Column, i: Column) -> Column:
        return F.when((i > 1) & late(x), x).otherwise(_day(x, key))

    return F.aggregate(F.sequence(F.lit(1), F.lit(100)), n.cast("int"), turn)


def pseudonym(match: Column, key: str = KEY) -> Column:
    """What stands in for a match of PATTERN: itself if it isn't valid."""
    digits, plain = _only(match, "0-9"), _only(match, "A-Z0-9")
    local = F.substring_index(match, "@", 1)
    email = F.concat(feistel(local, "email", key), F.substr(match, F.length(local) + 1, F.length(match)))
    hexadecimal = F.when(match.rlike("[a-f]"), feistel(match, "token", key, "0123456789abcdef")).otherwise(feistel(match, "token", key, "0123456789ABCDEF"))
    token = F.when(match.rlike("^[0-9]+$"), feistel(match, "token", key)).otherwise(hexadecimal)
    prefix = F.regexp_extract(match, "^(?:AKIA|ASIA|gh[a-z]_|sk_[a-z]+_)", 0)
    secret_ = F.concat(prefix, feistel(F.substr(match, F.length(prefix) + 1, F.length(match)), "key", key))
    country, account = F.substr(plain, F.lit(1), F.lit(2)), feistel(F.substr(plain, F.lit(5), F.lit(40)), "iban", key)
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = _laid(match, F.concat(country, check, account), "A-Z0-9")
    octets = F.split(match, r"\.")
    bits = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    hidden = feistel(bits, "ip", key, "0123456789abcdef")

    def octet(i: int) -> Column:
        value, was = F.conv(F.substr(hidden, F.lit(2 * i + 1), F.lit(2)), 16, 10), F.get(octets, F.lit(i))
        padded = (F.length(was) > 1) & was.startswith("0") & (F.length(value) < F.length(was))
        return F.when(padded, F.concat(F.repeat(F.lit("0"), F.length(was) - F.length(value)), value)).otherwise(value)

    ip = F.concat_ws(".", *(octet(i) for i in range(4)))
    far = feistel(_bits(match), "ipv6", key, "0123456789abcdef")
    ipv6 = F.concat_ws(":", *(F.substr(far, F.lit(4 * i + 1), F.lit(4)) for i in range(8)))
    ipv6 = F.when(match.rlike("[A-F]"), F.upper(ipv6)).otherwise(ipv6)
    number = F.date_diff(_date(match), F.lit(_FIRST).cast("date"))
    day, late = (F.date_add(F.lit(_FIRST).cast("date"), n) for n in (_day(number, key), _late_day(number, key)))
    date = (
        F.when(F.instr(match, "-") > 0, F.date_format(day, "yyyy-MM-dd"))
        .when(_month_first(match) & (F.instr(match, "/") > 0), F.date_format(late, "MM/dd/yyyy"))
        .when(_month_first(match), F.date_format(late, "MM.dd.yyyy"))
        .when(F.instr(match, "/") > 0, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "dd.MM.yyyy"))
    )
    zeros = F.when(match.startswith("00"), 2).otherwise(0)
    called = F.substr(digits, zeros + 1, F.lit(20))
    code = F.when(~match.rlike(r"^(?:\+|00)"), 0).when(F.substr(called, F.lit(1), F.lit(1)).isin("1", "7"), 1)
    head = zeros + code.when(F.substr(called, F.lit(1), F.lit(2)).isin(*CODES.split()), 2).otherwise(3)
    phone = _laid(match, F.concat(F.substr(digits, F.lit(1), head), feistel(F.substr(digits, head + 1, F.lit(20)), "phone", key)), "0-9")
    ssn = _laid(match, feistel(digits, "ssn", key), "0-9")
    payload = feistel(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key)
    card = _laid(match, F.concat(payload, ((10 - _luhn(F.concat(payload, F.lit("0"))) % 10) % 10).cast("string")), "0-9")
    k = kind(match)
    out = match
    for name, value in (("email", email), ("key", secret_), ("token", token), ("iban", iban), ("ip", ip), ("ipv6", ipv6), ("date", date), ("phone", phone), ("ssn", ssn), ("card", card)):
        out = F.when(k == name, value).otherwise(out)
    return out


def secret(spark: SparkSession) -> str:
    """The key that the session or the environment names, else the published default."""
    if key := spark.conf.get("spark.quaestor.pii.key", None) or os.environ.get("QUAESTOR_PII_KEY"):
        return key
    warnings.warn("no key in spark.quaestor.pii.key: pseudonyms made with the published default can be inverted", stacklevel=3)
    return KEY


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs with text_col's personal data replaced; all columns stay. A null text stays null, an empty one
    empty, a text without personal data is returned as it is, however long. An empty table stays empty, repeated rows stay."""
    return docs.withColumn(text_col, _replaced(F.col(text_col).cast("string"), key or secret(docs.sparkSession)))


def _valid(candidate: Column) -> Column:
    """The longest valid part of a candidate from its start, null if there is none."""

    def ends(at: Column) -> Column:
        return F.substr(candidate, at, F.lit(2)).rlike(r"^[A-Z0-9)](?:[^A-Za-z0-9]|$)")

    # a part of the kind the candidate is of: shorter values of other kinds are candidates of their own
    shape = F.when(candidate.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(candidate.rlike(r"^(?:\+|00)"), "phone").otherwise("card")
    parts = F.transform(F.filter(F.sequence(F.greatest(F.length(candidate), F.lit(8)), F.lit(8), F.lit(-1)), ends), lambda n: F.substr(candidate, F.lit(1), n))
    valid = F.filter(parts, lambda p: F.coalesce(kind(p) == shape, F.lit(False)))
    sizes = F.create_map(*(F.lit(x) for c in IBAN_SIZES.items() for x in c))

    def best(found: Column) -> Column:
        usual = F.filter(found, lambda p: F.length(_only(p, "A-Z0-9")) == sizes[F.substr(candidate, F.lit(1), F.lit(2))])
        return F.coalesce(F.get(usual, F.lit(0)), F.get(found, F.lit(0)))

    known = kind(candidate)
    return F.when(known.isin("email", "key", "token", "ip", "ipv6", "date", "phone", "ssn", "card"), candidate).when(
        candidate.rlike(r"^(?:\+?[0-9]|[A-Z]{2}[0-9]{2})[-A-Z0-9 .()]{7,}$"), _let(valid, best)
    )


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pieces(text: Column) -> Column:
    """What makes up a text, in order: struct(value, rest) of a valid value, or null, and what follows it."""
    found = F.struct(F.regexp_extract_all(text, F.lit(PLACES), F.lit(1)).alias("candidates"), F.split(text, PLACES, -1).alias("parts"))
    empty = F.array().cast("array<struct<value:string,rest:string>>")

    def step(s: Column, x: Column) -> Column:
        value = F.when(s.skip == 0, x.value)
        size = F.coalesce(F.length(value), s.skip)
        piece = F.struct(value.alias("value"), F.substr(x.part, size + 1, F.length(x.part)).alias("rest"))
        return F.struct(F.greatest(size - F.length(x.part), F.lit(0)).alias("skip"), F.concat(s.out, F.array(piece)).alias("out"))

    def walked(f: Column) -> Column:
        first = F.size(f.parts) - F.size(f.candidates)  # 0 if the text begins with a candidate: split gives no empty part there
        head = F.when(first == 0, "").otherwise(F.get(f.parts, F.lit(0)))
        steps = F.zip_with(F.slice(f.parts, first + 1, F.size(f.candidates)), f.candidates, lambda p, c: F.struct(p.alias("part"), _valid(c).alias("value")))
        begin = F.struct(F.lit(0).alias("skip"), F.concat(empty, F.array(F.struct(F.lit(None).cast("string").alias("value"), head.alias("rest")))).alias("out"))
        return F.aggregate(steps, begin, step, lambda s: s.out)

    return _let(found, walked)


def _replaced(text: Column, key: str) -> Column:
    pieces = F.transform(_pieces(text), lambda p: F.concat(F.coalesce(pseudonym(p.value, key), F.lit("")), p.rest))
    return F.when(text.rlike(PATTERN), F.array_join(pieces, "")).otherwise(text)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """(id, kind, value, pseudonym, n): the valid personal data of each row of docs and how often it occurs
    there. Null and empty texts have none."""
    key = key or secret(docs.sparkSession)
    text = F.col(text_col).cast("string")
    found = F.explode(F.transform(F.filter(F.when(text.rlike(PATTERN), _pieces(text)), lambda p: p.value.isNotNull()), lambda p: p.value))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), found.alias("value")).groupBy("id", "value").agg(F.count("*").alias("n"))
    return rows.select("id", kind(F.col("value")).alias("kind"), "value", pseudonym(F.col("value"), key).alias("pseudonym"), "n").where("kind is not null")
