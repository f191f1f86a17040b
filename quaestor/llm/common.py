"""What the operators share: bounded batches, bounded samples, joins by a checked size, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.session import load
from quaestor.shared import place, shared_dir, written

__all__ = ["bounded", "components", "crc_mod", "gathered", "least_hashed", "mapped", "place", "shared_dir", "slices", "table", "tasks", "without", "written"]

BATCH_BYTES = 4 << 20
SENT_ROWS = 500_000  # ids that may be sent to every executor: 4 MB of numbers, about 16 MB as a hash table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table; only Spark opens the path."""
    return load(spark, sf_dir, name)


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row) between the JVM and Python, in this session: a batch of the
    default 64 MB would stand in the memory of both, for every task at once. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    size = int(now.rstrip("bB")) if now.rstrip("bB").lstrip("-").isdigit() else -1
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with bounded batches."""
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut into short ones, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def without(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of df whose key isn't in the one column of ids (distinct, without nulls, written). A null key stays.
    Few ids are sent to the rows; more are joined by a shuffle, where a key with many rows is left to the adaptive
    skew join."""
    name = ids.columns[0]
    few = ids.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    ids = ids.withColumnRenamed(name, "__without")
    return df.join(F.broadcast(ids) if few else ids, key == F.col("__without"), "left_anti")


def least_hashed(hashes: DataFrame, most: int, total: int) -> int | None:
    """The bound up to which about `most` distinct values (never more) of the long column `hash` lie; None if there
    are none. Equal rows share a hash, so that a row with many copies is one of the sample's. total: how many rows."""
    if not total:
        return None
    span = 1 << 64
    top = min(span - 1, 2 * span * most // total) - (1 << 63)  # twice the share, as rows repeat
    for bound in (top, (1 << 63) - 1):
        near = hashes.where(F.col("hash") <= F.lit(bound)).select("hash").distinct().orderBy("hash").limit(most)
        last, n = near.agg(F.max("hash"), F.count("*")).first()
        if n or bound == (1 << 63) - 1:
            return last
    return None


def tasks(rows: int) -> int:
    """How many tasks should write so many narrow rows: each file made in a folder costs its task more than some rows do."""
    return max(min(8, 1 + rows // 2_000), rows // 250_000)


def gathered(df: DataFrame) -> DataFrame:
    """written(), in as few files as the narrow rows of df need. The tasks of df run as they are, each once: their rows are held
    on the executors' disks, counted, and written from there. What an executor loses is computed again."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return written(held.coalesce(tasks(held.count())))
    finally:
        held.unpersist()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the component's least node.

    Alternating large-star and small-star steps. Each step is a minimum by node and a distinct, nothing is
    gathered in one place, and every round is written to the shared folder, which cuts the lineage.
    Self-links, repeated links and null ends are dropped; no edges give no rows."""
    now = gathered(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark, few = None, tasks(now.count())
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.select(F.col("u"), F.col("m").alias("v")).union(
            star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = written(small.distinct().coalesce(few))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
