"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is named and all runs on one machine, a temporary one. On a
    cluster no machine's own folder will do, so the setting must be there."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        there = f"file://{tempfile.mkdtemp(prefix='quaestor-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there


def place(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quaestor-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: later readers neither compute it
    again nor depend on the executors that made it."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch space
            return
