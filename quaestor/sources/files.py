"""CSV, TSV, JSON, archive and generated sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.select(df.columns[:columns]) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """A header, then rows; a comma in a value becomes a space."""
    text = [F.translate(F.col(c).cast("string"), ",", " ").alias(c) for c in df.columns]
    df.select(*text).write.mode("overwrite").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("sep", "\t").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def publish(df: DataFrame, path: str, date: str) -> None:
    """A dump as a dated partition, compressed by zstd; older dates stay as the archive."""
    df.withColumn("dump_date", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dump_date").option("compression", "zstd").parquet(path)


def archive(spark: SparkSession, folder: str, newest: int = 3) -> DataFrame:
    """(table, date, size, modified) of the newest dumps per table; names are table-date, contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")
    named = files.select(F.regexp_extract("name", r"^(.*?)-([0-9].*)$", 1).alias("table"), F.regexp_extract("name", r"^(.*?)-([0-9].*)$", 2).alias("date"), "size", F.col("modificationTime").alias("modified"))
    return named.withColumn("__at", F.row_number().over(Window.partitionBy("table").orderBy(F.desc("date")))).where(F.col("__at") <= newest).drop("__at")


def calendar(spark: SparkSession, first: str, last: str, parts: Sequence[str]) -> DataFrame:
    """(month, part): every month from first to last for each part of a literal list."""
    months = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    return months.withColumn("part", F.explode(F.array(*map(F.lit, parts))))


def paged(pages: DataFrame, doc: str, language: str = "EN", kind: str = "text/xml") -> DataFrame:
    """(reference, url) from pages of search results as JSON: references, fragments, versions and files unnested, of the
    files with one language and kind, each url once."""
    version = "struct<language:string,fileInfos:array<struct<typeDoc:string,url:string>>>"
    schema = f"references array<struct<reference:string,fragments:array<struct<name:string,versions:array<{version}>>>>>"
    refs = pages.select(F.explode(F.from_json(doc, schema)["references"]).alias("r"))
    files = refs.select("r.reference", F.explode("r.fragments").alias("f")).select("reference", F.explode("f.versions").alias("v"))
    urls = files.where(F.col("v.language") == language).select("reference", F.explode("v.fileInfos").alias("i")).where(F.col("i.typeDoc") == kind)
    return urls.select("reference", F.col("i.url").alias("url")).dropDuplicates(["url"])


def unknown(seen: DataFrame, known: DataFrame, key: str, cut: str | None = None) -> DataFrame:
    """The rows of seen whose key, up to a mark, isn't known."""
    value: Column = F.col(key)
    if cut:
        seen = seen.withColumn(key, F.trim(F.substring_index(value, cut, 1)))
    return seen.join(known.select(key).distinct(), key, "left_anti")
