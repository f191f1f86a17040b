"""Dates in several formats, terms, open ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy")
# The first and last day of the parliamentary terms.
TERMS = (
    (1, "1979-07-17", "1984-07-23"), (2, "1984-07-24", "1989-07-24"), (3, "1989-07-25", "1994-07-18"),
    (4, "1994-07-19", "1999-07-19"), (5, "1999-07-20", "2004-07-19"), (6, "2004-07-20", "2009-07-13"),
    (7, "2009-07-14", "2014-06-30"), (8, "2014-07-01", "2019-07-01"), (9, "2019-07-02", "2024-07-15"),
)


def as_date(text: Column) -> Column:
    """A date in the first of FORMATS that fits, whatever follows a T; null if none does."""
    head = F.substring_index(text, "T", 1)
    return F.coalesce(*(F.try_to_date(head, f) for f in FORMATS))


def shown(text: Column) -> Column:
    """For display: unknown if none, empty for the year 9999, else Y/M/D."""
    return F.when(text.isNull() | (text == ""), "unknown date").when(text.startswith("9999"), "").otherwise(F.date_format(F.to_date(F.left(text, F.lit(10))), "yyyy/MM/dd"))


def iso(text: Column) -> Column:
    """Midnight of the first ten characters' day."""
    return F.date_format(F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"), "yyyy-MM-dd'T'HH:mm:ss")


def timestamp_or_date(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def term(date: Column) -> Column:
    """The number of the term that holds a date, else null."""
    out = F.lit(None).cast("int")
    for n, a, z in TERMS:
        out = F.when(date.cast("date").between(F.lit(a).cast("date"), F.lit(z).cast("date")), n).otherwise(out)
    return out


def terms_of_year(year: Column) -> Column:
    """The terms that have days in a year; two in an election year."""
    return F.filter(F.array(*(F.when(year.between(int(a[:4]), int(z[:4])), n) for n, a, z in TERMS)), lambda n: n.isNotNull())


def history(text: Column, sentinel: str = "9999-12-31T00:00:00") -> Column:
    """struct(start, end) of 'a / b' or 'a ...'; an open end is the sentinel."""
    parts = F.split(text, " ?/ ?")
    start = F.date_format(as_date(F.regexp_extract(F.trim(parts[0]), r"^\S+", 0)), "yyyy-MM-dd'T'HH:mm:ss")
    end = F.date_format(as_date(F.trim(F.get(parts, F.lit(1)))), "yyyy-MM-dd'T'HH:mm:ss")
    return F.struct(start.alias("start"), F.coalesce(end, F.lit(sentinel)).alias("end"))
