"""Order-dependent operators; every one takes the order as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.shared import written


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """The place of each row in one order, from 1, without a task that sees all rows: rows are dealt into ranges of the order, ranked
    within, and moved on by the sizes of the ranges before. The order should be total."""
    dealt = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __before long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, within + F.col("__before")).drop("__part", "__before")


def toggle(df: DataFrame, by: Sequence[str], order: Sequence[str], marker: Column, name: str = "state") -> DataFrame:
    """The last non-null marker at or before each row, 0 before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.coalesce(F.last(marker, ignorenulls=True).over(w), F.lit(0)))


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def sliding_errors(df: DataFrame, by: Sequence[str], order: Sequence[str], error: Column, window: int = 50, limit: int = 10) -> DataFrame:
    """errors: how many of the last `window` rows are errors; tripped: more than `limit` are."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, Window.currentRow)
    return df.withColumn("errors", F.sum(error.cast("long")).over(w)).withColumn("tripped", F.col("errors") > limit)


def segments(df: DataFrame, by: Sequence[str], order: Sequence[str], marker: Column, name: str = "segment") -> DataFrame:
    """The number of markers at or before each row: rows between two markers are one segment, 0 stands before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.when(marker, 1).otherwise(0).cast("long")).over(w))


def islands(df: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """(by, first, last, size) of runs of consecutive numbers."""
    rows = df.select(*by, n).distinct()
    island = F.col(n) - F.row_number().over(Window.partitionBy(*by).orderBy(n))
    runs = rows.withColumn("__i", island).groupBy(*by, "__i")
    return runs.agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("size")).drop("__i")


def ranges(df: DataFrame, by: Sequence[str], n: str, name: str = "ranges") -> DataFrame:
    """Numbers as text: 1-3,5,7-8."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    runs = islands(df, by, n).withColumn("__t", text).groupBy(*by)
    sorted_ = F.array_sort(F.collect_list(F.struct("first", "__t")))
    return runs.agg(F.array_join(F.transform(sorted_, lambda r: r["__t"]), ",").alias(name))


def progress(df: DataFrame, by: Sequence[str], percent: Column, order: Sequence[str], floor: Column | None = None) -> DataFrame:
    """The percent of the latest mapped event, not under `floor`, 0 where none is mapped."""
    mapped = F.max_by(percent, F.when(percent.isNotNull(), F.struct(*order)))
    low = F.max(floor) if floor is not None else F.lit(0)
    return df.groupBy(*by).agg(F.greatest(F.coalesce(mapped, F.lit(0)), F.coalesce(low, F.lit(0))).alias("progress"))


def weighted_rank(df: DataFrame, by: Sequence[str], current: Column, weight: Column, base: float = -1.0) -> DataFrame:
    """base plus the weights of the current roles."""
    return df.groupBy(*by).agg((F.lit(base) + F.sum(F.when(current, weight).otherwise(0.0))).alias("score"))


def mixed_key(text: Column) -> Column:
    """A sort key for numbers kept as text: the number, else the code of the first character."""
    return F.coalesce(text.try_cast("long"), F.ascii(text).cast("long"))
