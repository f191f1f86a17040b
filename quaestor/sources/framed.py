"""Framed JSON: one document a line, each line begun by [ , or ], so that a dump is a JSON array and still splits by lines."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.shared import written

POINTER = "CURRENT"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(pos, doc): the JSON text of each document. pos grows with the place in the dump."""
    lines = spark.read.text(current(spark, path)).select(F.expr("substring(value, 2)").alias("doc"), F.monotonically_increasing_id().alias("pos"))
    return lines.where(F.trim("doc") != "").select("pos", "doc")


def read_table(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A typed table: the last of documents with one key. A missing path gives an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    empty = not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if empty:
        return spark.createDataFrame([], schema)
    rows = read(spark, path).select("pos", F.from_json("doc", schema).alias("row"))
    return rows.groupBy(F.col(f"row.{key}").alias("__key")).agg(F.max_by("row", "pos").alias("row")).select("row.*")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str:
    """Where the dump at a path is: the version that its pointer names, or the path itself if there is none."""
    jvm, pointer, fs = _hadoop(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return path
    return f"{path.rstrip('/')}/{spark.read.text(pointer.toString()).first().value}"


def write(df: DataFrame, path: str) -> None:
    """df as a framed dump: files whose lines, in the order of their names, are one JSON array in the order of df's
    partitions. The rows are computed and written by many tasks. The dump is a new version under the path; a small
    file that names it is then moved over the one before, which the file systems do at once, so that readers see the old or the new dump. The version
    before stays for those who read it still, older ones go. An empty table is an empty array."""
    spark = df.sparkSession
    lines = written(df.select(F.to_json(F.struct("*")).alias("json"), F.monotonically_increasing_id().alias("at")))
    first = lines.agg(F.min("at")).first()[0]
    framed = lines.select(F.concat(F.when(F.col("at") == F.lit(first), "[").otherwise(","), "json").alias("value"), "at")
    end = [("]", (1 << 63) - 1)] if first is not None else [("[", -1), ("]", (1 << 63) - 1)]
    framed = framed.union(spark.createDataFrame(end, "value string, at long"))
    base = path.rstrip("/")
    version = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    framed.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(f"{base}/{version}")
    jvm, folder, fs = _hadoop(spark, base)
    before = current(spark, path).rsplit("/", 1)[-1]
    made = jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(made)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(made, jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}"), options)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            fs.delete(status.getPath(), True)
