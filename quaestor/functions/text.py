"""Scalar functions on text, as Column expressions where Spark has what they need."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

PERSON = StructType().add("title", StringType()).add("sur", StringType()).add("family", StringType()).add("aliases", ArrayType(StringType()))
SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"


def collapse(text: Column) -> Column:
    """White space, in the Unicode sense, as single spaces, and none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


@F.pandas_udf(StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """A name as it is compared: ß as ss, without accents, other non-ASCII characters and white space, in lower case."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = unicodedata.normalize("NFKD", x.replace("ß", "ss")).encode("ascii", "ignore").decode()
        return "".join(plain.split()).lower()

    return names.map(one)


@lru_cache(maxsize=1)
def _plain() -> tuple[str, str, dict[str, str]]:
    """Of all characters that decompose to ASCII ones: those with one, what each becomes, and those with more."""
    one, many = {}, {"ß": "ss"}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[c] = plain
        elif plain:
            many[c] = plain
    return "".join(one), "".join(one.values()), many


def folded_name(text: Column) -> Column:
    """normalize_name() as a Column expression, for use within arrays: ß as ss, without accents, other non-ASCII characters and
    white space, in lower case. Characters that become more than one are rare and looked up one by one."""
    before, after, many = _plain()
    table = F.create_map(*(F.lit(x) for kv in many.items() for x in kv))
    wide = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    spread = F.when(text.rlike("[" + "".join(map(re.escape, many)) + "]"), wide).otherwise(text)
    return F.lower(F.regexp_replace(F.translate(spread, before, after), r"[^\x00-\x7f]+|[\s\x0b\x1c-\x1f]+", ""))


def normalize_ascii(text: Column) -> Column:
    """Lower-case ASCII letters and digits only; equals the Unicode form on ASCII text."""
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def slug(text: Column, folder: str, extension: str) -> Column:
    """A path from a label: empty for none, NA is NI, lower case, / as _."""
    name = F.when(text == "NA", "NI").otherwise(text)
    return F.when(text.isNull() | (text == ""), "").otherwise(F.concat(F.lit(folder), F.translate(F.lower(name), "/", "_"), F.lit(extension)))


# What separates names, in the order of splitting.
NAME_SEPARATORS = (", ", " and ", " & ", "; ", ",")


def split_names(text: Column) -> Column:
    """The names of an author line: what stands before ' on behalf ', cut at the separators, without marks at the ends."""
    head = F.substring_index(text, " on behalf ", 1)
    parts = F.split(head, "|".join(re.escape(s) for s in NAME_SEPARATORS))
    clean = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^[,' ;]+|[,' ;]+$", ""))
    clean = F.transform(clean, lambda p: F.regexp_replace(p, r"^.*Shadow\)\s*", ""))
    return F.filter(clean, lambda p: (p != "") & ~F.lower(p).startswith("on behalf of"))


def deobfuscated(mail: Column) -> Column:
    """A mail address that is written backwards with [at] and [dot]."""
    plain = F.replace(F.replace(F.replace(mail, F.lit("mailto:"), F.lit("")), F.lit("[dot]"), F.lit(".")), F.lit("[at]"), F.lit("@"))
    return F.reverse(plain)


def base26(letters: Column) -> Column:
    """a is 1, z 26, aa 27."""
    return F.aggregate(F.split(F.lower(letters), ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 96)


def roman(text: Column) -> Column:
    """The number of a roman numeral."""
    values = F.create_map(*(F.lit(x) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv))
    digits = F.transform(F.split(F.lower(text), ""), lambda c: values[c])
    return F.aggregate(F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.get(digits, i + 1), F.lit(0)), -d).otherwise(d)), F.lit(0), lambda a, d: a + d)


def slice_path(ref: Column) -> Column:
    """The three characters before the last, a slash, and the first nine."""
    return F.concat(F.substr(ref, F.length(ref) - 3, F.lit(3)), F.lit("/"), F.substr(ref, F.lit(1), F.lit(9)))


def human_size(size: Column) -> Column:
    """Bytes in binary units with one decimal."""
    units = F.array(*(F.lit(u) for u in ("bytes", "KiB", "MiB", "GiB", "TiB", "PiB")))
    order = F.when(size > 0, F.least(F.floor(F.log2(size.cast("double")) / 10), F.lit(5))).otherwise(0).cast("int")
    return F.concat(F.format_string("%.1f", F.bround(size / F.pow(F.lit(1024.0), order), 1)), F.lit(" "), F.get(units, order))


# Rewrites of legal bases, applied in order, each to what the one before left.
LEGAL_BASES = (
    (r"^Treaty on the Functioning of the EU TFEU ", "TFEU "),
    (r"^Treaty on the European Union \(after Amsterdam\) M ", "TEU "),
    (r"^Treaty on European Union TEU ", "TEU "),
    (r"^Rules of Procedure EP ", "EP "),
)


def rewritten(items: Column, rules: Sequence[tuple[str, str]] = LEGAL_BASES) -> Column:
    """An array's elements after all rewrites."""

    def one(x: Column) -> Column:
        for pattern, to in rules:
            x = F.regexp_replace(x, pattern, to)
        return x

    return F.transform(items, one)


DOSSIER = r"[0-9]{4}/[0-9]{4}[A-Z]?\([A-Z*]{3}\)"


def dossier_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DOSSIER), F.lit(0))


def split_last(text: Column, separator: str = " - ") -> Column:
    """struct(head, last): what stands before the last separator, and after it; without one all is head."""
    parts = F.split(text, re.escape(separator))
    n = F.size(parts)
    head = F.when(n > 1, F.array_join(F.slice(parts, 1, n - 1), separator)).otherwise(text)
    return F.struct(head.alias("head"), F.when(n > 1, F.element_at(parts, -1)).alias("last"))


def party_country(text: Column) -> Column:
    """struct(party, country) of 'Party (Country)', cut at the last bracket; null if there is none."""
    pattern = r"^(.*) \((.*)\)$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("party"), F.regexp_extract(text, pattern, 2).alias("country")))


def labels(code: Column, names: Mapping[str, str], default: str | None = None) -> Column:
    """A small dictionary's value."""
    found = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[code] if names else F.lit(None)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def is_abbreviation(text: Column) -> Column:
    """Capitals, each with a dot."""
    return text.rlike(r"^(\p{Lu}\.)+$")


def ciphered(text: Column, plain: str, cipher: str) -> Column:
    """A substitution cipher; its key is given."""
    return F.translate(text, plain, cipher)


@F.pandas_udf(StringType())
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """HTML with <del> and <ins> around what differs, word by word."""

    def one(a: str | None, b: str | None) -> str:
        x, y = re.findall(r"\s+|\S+", a or ""), re.findall(r"\s+|\S+", b or "")
        out = []
        for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            gone, come = html.escape("".join(x[i:j])), html.escape("".join(y[k:m]))
            out.append(f"<span>{gone}</span>" if op == "equal" else (f"<del>{gone}</del>" if gone else "") + (f"<ins>{come}</ins>" if come else ""))
        return "".join(out)

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


def highlighted(text: Column, query: str) -> Column:
    """Escaped text with the words of a query in <span>."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    terms = F.array(*(F.lit(t.lower()) for t in query.split())) if query.split() else F.array().cast("array<string>")
    words = F.transform(F.split(safe, " "), lambda w: F.when(F.array_contains(terms, F.lower(w)), F.concat(F.lit("<span>"), w, F.lit("</span>"))).otherwise(w))
    return F.array_join(words, " ")


@F.pandas_udf(PERSON)
def person_name(names: pd.Series) -> pd.DataFrame:
    """A full name's title, given names, family name (from the first upper-case word or particle) and aliases."""
    particles, titles = {"de", "van", "von", "del"}, {"Dr", "Dr.", "Prof", "Prof.", "Sir", "Lord", "Baroness"}

    def one(full: str | None) -> tuple:
        words = (full or "").split()
        title = []
        while words and words[0] in titles:
            title.append(words.pop(0))

        def family(i: int) -> bool:
            w = words[i]
            if w.lower() in particles and i or re.fullmatch(r"Mc[A-Z]+", w):
                return True
            return w == w.upper() and any(c.isalpha() for c in w) and not re.fullmatch(r"(\w\.)+", w) and len(w) > 1

        cut = next((i for i in range(len(words)) if family(i)), max(0, len(words) - 1))
        sur, fam, lead = " ".join(words[:cut]), " ".join(words[cut:]), " ".join(title)
        forms = [f"{sur} {fam}", f"{fam} {sur}", fam, f"{lead} {sur} {fam}", f"{lead} {fam}", f"{fam} {sur} {lead}"]
        return lead or None, sur, fam, list(dict.fromkeys(" ".join(f.split()) for f in forms if f.strip()))

    return pd.DataFrame([one(n) for n in names], columns=["title", "sur", "family", "aliases"])


def document_number(url: Column) -> Column:
    """PE number of a document's url, in either of two styles; null if it has none."""
    dotted, dashed = r"PE[-_ ]?([0-9]{3})\.([0-9]{3})", r"PE[-_]?([0-9]{3})([0-9]{3})"
    for_dots = F.concat(F.lit("PE"), F.regexp_extract(url, dotted, 1), F.lit("."), F.regexp_extract(url, dotted, 2))
    plain = F.concat(F.lit("PE"), F.regexp_extract(url, dashed, 1), F.lit("."), F.regexp_extract(url, dashed, 2))
    return F.when(url.rlike(dotted), for_dots).when(url.rlike(dashed), plain)


def document_reference(url: Column) -> Column:
    """A9-0001/2020 of a url that ends in A-9-2020-0001_EN.html, RC-B9-0001/2020 of one of a joint motion."""
    pattern = r"(RC|A|B)-([0-9])-([0-9]{4})-([0-9]{4})"
    kind, term, year, number = (F.regexp_extract(url, pattern, i) for i in range(1, 5))
    head = F.when(kind == "RC", "RC-B").otherwise(kind)
    return F.when(url.rlike(pattern), F.concat(head, term, F.lit("-"), number, F.lit("/"), year))


def phone(text: Column) -> Column:
    """A number with its international prefix: 0(0) 32 and 32 as +32."""
    return F.regexp_replace(F.regexp_replace(text, r"^0\(0\)|^00", "+"), r"^(32|33)(?=\s|[0-9]{6,})", "+$1")


def zip_city(text: Column) -> Column:
    """struct(zip, city) of 'B-1047 Brussels'."""
    pattern = r"^((?:[A-Z]{1,2}-)?[0-9]{4,5})\s+(.*)$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("zip"), F.regexp_extract(text, pattern, 2).alias("city")))


def link(label: Column, path: Column, default: str = "Unknown") -> Column:
    """An HTML link, the default where there is no label."""
    return F.format_string('<a href="%s">%s</a>', path, F.coalesce(label, F.lit(default)))


def row_number_stripped(text: Column) -> Column:
    """A table cell without the number that begins it."""
    return F.regexp_replace(text, r"^\s*[0-9]+[.)]?\s+", "")


def token() -> Column:
    """A random key of 40 hexadecimal digits."""
    return F.sha1(F.uuid())
