"""Entity resolution by name, then date, then group: a cascade that answers only where one candidate is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(candidates: DataFrame, probe: str, entity: str, valid: Column, group_hit: Column, label_hit: Column, dated: Column) -> DataFrame:
    """(probe, entity or null) from a row per probe and candidate.

    One candidate: it, whatever the date. More without a date: null. Then those valid at the date: none, null;
    one, it. Then those valid whose group id fits: exactly one, it; then by the group's name likewise; else null."""
    c = candidates.select(probe, entity, valid.alias("__v"), group_hit.alias("__g"), label_hit.alias("__l"), dated.alias("__d"))

    def only(hit: Column) -> Column:
        return F.when(F.count_if(hit) == 1, F.min(F.when(hit, F.col(entity))))

    v = F.coalesce(F.col("__v"), F.lit(False))
    g, label = v & F.coalesce(F.col("__g"), F.lit(False)), v & F.coalesce(F.col("__l"), F.lit(False))
    one = F.when(F.count(entity) == 1, F.min(entity))
    later = F.when(F.bool_or("__d"), F.coalesce(only(v), F.when(F.count_if(v) > 1, F.coalesce(only(g), only(label)))))
    return c.groupBy(probe).agg(F.coalesce(one, F.when(F.count(entity) > 1, later)).alias(entity))


def unambiguous(df: DataFrame, name: str, entity: str) -> DataFrame:
    """Names that lead to one entity only, with it."""
    n = F.count("*").over(Window.partitionBy(name))
    return df.select(name, entity).distinct().withColumn("__n", n).where("__n = 1").drop("__n")
