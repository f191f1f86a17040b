"""Structured Streaming: the circuit breaker with reset, upserts by micro-batch, notifications; and, beyond the model, event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, LIMIT = 50, 10
STATE = "outcomes array<int>, trips long"
OUT = "source string, jobs long, trips long, errors long"


def breaker_step(outcomes: list[int], trips: int, errors: Iterator[bool], idle: Iterator[bool] | None = None) -> tuple[list[int], int, int]:
    """(last outcomes, trips, jobs) after some more: over LIMIT errors among the last WINDOW trip, which forgets all. So does
    a job that was queued when its source had none (idle)."""
    n = 0
    for e, fresh in zip(errors, idle if idle is not None else repeat(False)):
        n += 1
        if fresh:
            outcomes = []
        outcomes = [*outcomes, int(e)][-WINDOW:]
        if sum(outcomes) > LIMIT:
            outcomes, trips = [], trips + 1
    return outcomes, trips, n


def breaker(jobs: DataFrame) -> DataFrame:
    """(source, jobs, trips, errors) from a stream of (source, seq, error) and perhaps idle, updated per micro-batch. A micro-batch's
    jobs count in the order of seq; files of a stream must hold later jobs than those before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcomes, trips = state.get if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        outcomes, trips, n = breaker_step(list(outcomes), trips, iter(rows["error"]), iter(rows["idle"]) if "idle" in rows else None)
        state.update((outcomes, trips))
        yield pd.DataFrame([(key[0], n, trips, sum(outcomes))], columns=["source", "jobs", "trips", "errors"])

    return jobs.groupBy("source").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there, by micro-batch, then the end: when nothing is queued or running the caller publishes."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def files(spark: SparkSession, path: str, schema: str, per_batch: int = 8) -> DataFrame:
    """A stream of Parquet files, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Beyond the model: counts in tumbling event-time windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).count()
