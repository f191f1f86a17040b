"""Vote matrices: cells, marginals and heat classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(sign: Column, plus: str = "+", minus: str = "-", zero: str = "0") -> list[Column]:
    return [
        F.count_if(sign == plus).alias("plus"),
        F.count_if(sign == minus).alias("minus"),
        F.count_if(sign == zero).alias("zero"),
        F.count("*").alias("total"),
    ]


def cells(ballots: DataFrame, by: Sequence[str], sign: Column, **signs: str) -> DataFrame:
    return ballots.groupBy(*by).agg(*tally(sign, **signs))


def marginals(ballots: DataFrame, group: str, country: str, sign: Column, vote: Sequence[str] = (), **signs: str) -> DataFrame:
    """Cells, group, country and vote totals in one pass; level: cell, group, country or vote."""
    v, g, c = [F.col(x) for x in vote], F.col(group), F.col(country)
    sets = [[*v, g, c], [*v, g], [*v, c], v]
    out = ballots.groupingSets(sets, *v, g, c).agg(*tally(sign, **signs), F.grouping(group).alias("__g"), F.grouping(country).alias("__c"))
    level = F.when((F.col("__g") == 0) & (F.col("__c") == 0), "cell").when(F.col("__g") == 0, "group").when(F.col("__c") == 0, "country").otherwise("vote")
    return out.withColumn("level", level).drop("__g", "__c")


def round_away(x: Column) -> Column:
    """Away from zero: floor below it, ceiling above."""
    return F.when(x < 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def heat(df: DataFrame, difference: Column, over: Sequence[str], name: str = "heat") -> DataFrame:
    """The class of each row's difference on a scale of ten spans of its partition; null where all are equal."""
    with_d = df.withColumn("__d", difference)
    if not over:  # one row of totals instead of one task with all rows
        span = F.col("__span")
        with_d = with_d.crossJoin(F.broadcast(with_d.agg((F.max("__d") - F.min("__d")).alias("__span"))))
        return with_d.withColumn(name, round_away(F.try_divide(F.col("__d") * 10, span))).drop("__d", "__span")
    w = Window.partitionBy(*over)
    span = F.max("__d").over(w) - F.min("__d").over(w)
    return with_d.withColumn(name, round_away(F.try_divide(F.col("__d") * 10, span))).drop("__d")
