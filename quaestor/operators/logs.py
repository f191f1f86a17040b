"""Log lines as records, and counts over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The levels of a log line.
LEVELS = ("quiet", "error", "warning", "info", "debug")
TRACEBACK = "Traceback (most recent call last):"


def parsed(lines: DataFrame, modules: Sequence[str], text: str = "value") -> DataFrame:
    """lines with ts, module, level, msg; null where a line is no record: at least four tokens, a known module and level."""
    pattern = r"^(\S+) (\S+) (\S+) (.+)$"
    part = [F.regexp_extract(F.col(text), pattern, i) for i in range(1, 5)]
    good = (F.size(F.split(F.trim(text), r"\s+")) >= 4) & part[1].isin(*modules) & part[2].isin(*LEVELS)
    names = ("ts", "module", "level", "msg")
    values = [F.try_to_timestamp(part[0]), *part[1:]]
    return lines.select("*", *(F.when(good, v).alias(n) for n, v in zip(names, values, strict=True)))


def assembled(records: DataFrame, by: Sequence[str], pos: str, text: str = "value") -> DataFrame:
    """A row per record with its continuation lines in order (column more); lines before the first record form record 0."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = records.withColumn("record", F.count("level").over(w))
    more = F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct(pos, text)))), lambda r: r[text])
    first = [F.min_by(c, pos).alias(c) for c in ("ts", "module", "level", "msg")]
    return numbered.groupBy(*by, "record").agg(*first, more.alias("more"))


def level_stats(df: DataFrame, by: Sequence[str | Column], level: Column, error: Column) -> DataFrame:
    return df.groupBy(*by, level).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"))


def top_messages(df: DataFrame, message: str, k: int) -> DataFrame:
    """The k most frequent messages, ties to the smaller."""
    return df.groupBy(message).agg(F.count("*").alias("n")).orderBy(F.desc("n"), message).limit(k)
