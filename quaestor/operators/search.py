"""Keyword search, search with a fallback, facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import folded_name


def terms_pattern(query: str) -> str:
    """A pattern that holds on text of which one line has all white-space separated terms, in any order and
    case. Look-aheads; only a line feed ends a line."""
    terms = query.split()
    quoted = [r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms]
    return "(?imud)" + ("^" + "".join(f"(?=.*{q})" for q in quoted) if len(quoted) > 1 else "".join(quoted))


def has_terms(text: Column, query: str) -> Column:
    return text.rlike(terms_pattern(query)) if query.split() else F.lit(False)


def any_field(fields: Sequence[Column], query: str) -> Column:
    """One of the fields holds all terms."""
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(has_terms(f, query), F.lit(False))
    return out


def exact_or_pattern(df: DataFrame, exact: Column, pattern: Column) -> DataFrame:
    """The rows that fit exactly; only if there are none, those that fit the pattern."""
    some = df.where(exact).select(F.lit(True).alias("__some")).limit(1)
    loose = df.where(pattern).join(some, F.lit(True), "left_anti")
    return df.where(exact).unionByName(loose)


def faceted(df: DataFrame, chosen: Mapping[str, Sequence]) -> DataFrame:
    """Rows that have, in each column with choices, one of them."""
    for column, values in chosen.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def facet_values(df: DataFrame, columns: Sequence[str], chosen: Mapping[str, Sequence]) -> DataFrame:
    """(facet, value, n): what can still be chosen: values of the visible rows, and, in a column that
    has choices, those of the rows that the other columns leave."""
    out = None
    for c in columns:
        visible = faceted(df, {k: v for k, v in chosen.items() if k != c})
        part = visible.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def normal_name(text: Column) -> Column:
    """A name as it is compared: ß as ss, without accents and white space, in lower case."""
    return folded_name(text)
