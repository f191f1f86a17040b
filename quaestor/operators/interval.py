"""Valid-time intervals: both ends count, list order decides ties, open ends are null or the sentinel year 9999."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = "9999-12-31T00:00:00"


def normal_end(end: Column, as_of: Column) -> Column:
    """An end date as it is compared: sentinels, the malformed form among them, become as_of."""
    return F.when(end.isin(OPEN, "31-12-9999T00:00:00") | end.isNull(), as_of).otherwise(end)


def first_valid(items: Column, at: Column, start: str = "start", end: str = "end") -> Column:
    """The first element of an array of structs that is valid at a date, else null; needs no join."""
    return F.get(F.filter(items, lambda i: (i[start] <= at) & (at <= i[end])), F.lit(0))


def interval_join(
    left: DataFrame, right: DataFrame, key: str, at: str, start: str, end: str, pos: str, how: str = "left", period: Callable[[Column], Column] = F.year
) -> DataFrame:
    """left with a struct column `match`: right's first row by pos, of the same key, valid at left's date. left needs a column
    `row` that names its rows. The join is on the key and a period (whole number that grows with the date), so that rows of a
    hot key meet only those of their own period; right's rows stand in each period of left's that they reach."""
    low, high = (left.agg(f(period(F.col(at)))).scalar() for f in (F.min, F.max))
    first, last = F.greatest(period(F.col(start)), low), F.least(period(F.col(end)), high)
    reached = F.explode(F.when(low.isNotNull() & (first <= last), F.sequence(first, last))).alias("__period")
    item = right.select(key, F.struct(*(F.col(c) for c in right.columns if c != key)).alias("__item"), reached)
    inside = (F.col(f"__item.{start}") <= F.col(at)) & (F.col(at) <= F.col(f"__item.{end}"))
    hits = left.select("row", key, at, period(F.col(at)).alias("__period")).join(item, [key, "__period"]).where(inside)
    best = hits.groupBy("row").agg(F.min_by("__item", F.col(f"__item.{pos}")).alias("match"))
    return left.join(best, "row", how)


def expand_days(df: DataFrame, key: str, start: str, end: str, value: str, pos: str, low: str, high: str) -> DataFrame:
    """(key, day, value): intervals clipped to [low, high], one row a day; of overlapping ones the last by pos wins."""
    first, last = F.greatest(F.to_date(start), F.lit(low).cast("date")), F.least(F.to_date(end), F.lit(high).cast("date"))
    clipped = df.withColumn("__a", first).withColumn("__z", last).where(F.col("__a") <= F.col("__z"))
    days = clipped.withColumn("day", F.explode(F.sequence("__a", "__z")))
    return days.groupBy(key, "day").agg(F.max_by(value, pos).alias(value))


def valid_at(at: Column, start: Column, end: Column) -> Column:
    return end.isNull() | ((start <= at) & (at <= end))
