"""Roll-ups of nested and of several sources, timelines, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.ordered import global_rank


def pivot_report(acts: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """A row per key with a count per kind, 0 where there is none. The kinds are given, so no job looks for them."""
    return acts.groupBy(key).pivot(kind, list(kinds)).count().na.fill(0, list(kinds))


def two_sources(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two roll-ups over the union of their keys; what a source lacks is null."""
    return left.join(right, key, "full_outer")


def profile(sources: Sequence[tuple[DataFrame, Column, Column, Column]], key: str) -> DataFrame:
    """Counts per (key, type) and per (key, item) over several sources (frame, key, type, item); facet says which."""
    rows = None
    for df, k, kind, item in sources:
        part = df.select(k.alias(key), kind.alias("type"), item.alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.groupingSets([[F.col(key), F.col("type")], [F.col(key), F.col("item")]], F.col(key), F.col("type"), F.col("item")).agg(
        F.count("*").alias("n"), F.grouping("type").alias("__t")
    )
    value = F.when(F.col("__t") == 0, F.col("type")).otherwise(F.col("item"))
    return out.select(key, F.when(F.col("__t") == 0, "type").otherwise("item").alias("facet"), value.alias("value"), "n")


def grouped_with_total(df: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, kind, n, total, place): counts per kind, each key's total and the key's place by it, ties to the smaller key."""
    n = df.groupBy(by, kind).agg(F.count("*").alias("n"))
    total = n.withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    places = global_rank(total.select(by, "total").distinct(), [F.desc("total"), F.asc(by)])
    return total.join(places.drop("total"), by)


def nested(df: DataFrame, by: Sequence[str], first: Sequence[str], items: Sequence[str], pos: str) -> DataFrame:
    """Flat rows as a row per key: attributes first seen, items in order."""
    attributes = [F.min_by(c, pos).alias(c) for c in first]
    listed = F.array_sort(F.collect_list(F.struct(pos, *(c for c in items if c != pos)))).alias("items")
    return df.groupBy(*by).agg(*attributes, listed)


def timeline(*sources: tuple[DataFrame, Column, Column, Column, Column]) -> DataFrame:
    """(key, kind, ref, ts) of several sources (frame, key, kind, ref, ts); rows without a date are left out."""
    out = None
    for df, key, kind, ref, ts in sources:
        part = df.select(key.alias("key"), kind.alias("kind"), ref.alias("ref"), ts.alias("ts")).where("ts is not null")
        out = part if out is None else out.unionByName(part)
    return out


def zipped(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs by position within a key, full outer: what one side lacks is null. Both have columns by, pos."""
    return left.join(right, [*by, "pos"], "full_outer")


def valid_prefix(pairs: DataFrame, by: Sequence[str], mismatch: Column) -> DataFrame:
    """The pairs before a key's first mismatch."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pairs.withColumn("__bad", F.max(F.when(mismatch, 1).otherwise(0)).over(w)).where("__bad = 0").drop("__bad")
