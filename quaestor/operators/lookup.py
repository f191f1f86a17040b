"""Point, positional and cascading lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multi_get(df: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """A row per wanted key, in order (column pos from 0), nulls for misses. The keys are a literal list."""
    kind = df.schema[key].dataType.simpleString()
    asked = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(wanted)], f"pos int, wanted {kind}")
    return asked.join(df, F.col("wanted") == df[key], "left")


def priority_lookup(df: DataFrame, stages: Sequence[tuple[DataFrame, Column, str]], name: str) -> DataFrame:
    """The first hit of ordered left joins: each stage is (table, condition, value column). A stage's table
    has at most one row for a row of df."""
    values = []
    for i, (table, condition, value) in enumerate(stages):
        df = df.join(table, condition, "left")
        values.append(table[value])
    return df.withColumn(name, F.coalesce(*values))


def prefix_rules(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The category of the first (prefix, category) rule that text starts with. Rules are a literal list, so
    that no join is needed."""
    out = F.lit(default)
    for prefix, category in reversed(rules):
        out = F.when(text.startswith(prefix), F.lit(category)).otherwise(out)
    return out


def union_roles(*sources: tuple[DataFrame, str, str, Column]) -> DataFrame:
    """(key, person, role) of several sources (frame, key column, person column, role)."""
    out = None
    for df, key, person, role in sources:
        part = df.select(F.col(key).alias("key"), F.col(person).alias("person"), role.alias("role")).where(F.col("role").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def first_match(items: Column, condition, value, default) -> Column:
    """An attribute of the first array element that fits, else the default."""
    return F.coalesce(value(F.get(F.filter(items, condition), F.lit(0))), F.lit(default))
