"""Inverted indexes: exploded keys, grouped where the list itself is the answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inverted_index(df: DataFrame, keys: Column, *, distinct: bool = True, keep_null: bool = False, name: str = "k") -> DataFrame:
    """One row of df per key in the array `keys`. distinct: a row has each key once. keep_null: rows without
    keys stay under a null key, and null keys stay."""
    found = F.array_distinct(keys) if distinct else keys
    if keep_null:
        return df.withColumn(name, F.explode_outer(found))
    return df.withColumn(name, F.explode(found)).where(F.col(name).isNotNull())


def postings(index: DataFrame, doc: Column, pos: Column, name: str = "k") -> DataFrame:
    """(key, docs): each key's documents in table order."""
    grouped = index.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), doc.alias("doc")))).alias("docs"))
    return grouped.withColumn("docs", F.transform("docs", lambda d: d.doc))


def key_counts(index: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return index.groupBy(*keys).agg(F.count("*").alias(name))


def last_wins(df: DataFrame, keys: Sequence[str], pos: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last one by `pos`; the columns of df."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*pos))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest)).select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], pos: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*pos))
    return df.groupBy(*keys).agg(first.alias("__first")).select(*keys, *(F.col(f"__first.{c}").alias(c) for c in rest)).select(*df.columns)


def union_distinct(*indexes: DataFrame) -> DataFrame:
    """Several sources' (key, doc) rows as one index without repeats."""
    out = indexes[0]
    for other in indexes[1:]:
        out = out.unionByName(other)
    return out.distinct()
