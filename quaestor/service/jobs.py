"""Jobs as rows. A plug-in is a module with scrape(**job); its jobs run once each in the tasks, what fails is kept with its error,
and what is done starts the jobs of the plug-ins that come after it."""

from __future__ import annotations

import importlib.util
import json
import time
import traceback
from collections.abc import Callable, Hashable, Iterator, Mapping, Sequence
from pathlib import Path
from types import ModuleType
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The settings of a plug-in without its own, and which plug-ins' jobs come after which.
DEFAULTS = {"threads": 8, "timeout": 60, "retries": 5, "abort_on_error": False}
CHAIN = {"meps": ["mep"], "mep": ["dossiers"], "dossiers": ["mep_activities", "pvotes", "amendments", "comagendas"], "pvotes": ["plenaries"]}


def plugins(folder: str, defaults: Mapping[str, Any] = DEFAULTS) -> tuple[dict[str, ModuleType], dict[str, str]]:
    """(modules by name, errors by name): every module of a folder whose name doesn't begin with _ and that has scrape(). Its CONFIG is
    laid over the defaults. One that can't be loaded is left out, with what is wrong."""
    found, errors = {}, {}
    for path in sorted(Path(folder).glob("*.py")):
        name = path.stem
        if name.startswith("_"):
            continue
        try:
            spec = importlib.util.spec_from_file_location(f"quaestor_plugin_{name}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            module.scrape  # noqa: B018
            module.CONFIG = {**defaults, **getattr(module, "CONFIG", {})}
            found[name] = module
        except Exception:  # noqa: BLE001  one bad plug-in must not end the others
            errors[name] = traceback.format_exc(limit=1)
    return found, errors


def attempted(jobs: DataFrame, work: Callable[..., Any]) -> DataFrame:
    """(source, seq, job, result, error): each job (source, seq, job as a JSON object of arguments) tried once. What it returns comes as JSON;
    an error is kept, and the job isn't tried again. Write the result: a plan that is run again works again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for source, seq, job in zip(f["source"], f["seq"], f["job"], strict=True):
                try:
                    out.append((source, seq, job, json.dumps(work(**json.loads(job)), default=str, ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001  the error is the row's
                    out.append((source, seq, job, None, repr(e)))
            yield pd.DataFrame(out, columns=["source", "seq", "job", "result", "error"])

    return jobs.select("source", F.col("seq").cast("long"), "job").mapInPandas(run, "source string, seq long, job string, result string, error string")


def dead_letters(done: DataFrame) -> DataFrame:
    """The jobs that failed, with their errors."""
    return done.where("error is not null").select("source", "seq", "job", "error")


def counters(jobs: DataFrame, state: str = "state") -> DataFrame:
    """(source, state, n): how many jobs of each source are in which state; none are left out."""
    return jobs.groupBy("source", F.col(state).alias("state")).agg(F.count("*").alias("n"))


def order(chain: Mapping[str, Sequence[str]] = CHAIN) -> list[str]:
    """The names in an order in which each comes after what it follows. ValueError on a circle."""
    names = list(dict.fromkeys([*chain, *(n for after in chain.values() for n in after)]))
    waits = {n: {k for k, after in chain.items() if n in after} for n in names}
    out: list[str] = []
    while len(out) < len(names):
        ready = [n for n in names if n not in out and waits[n] <= set(out)]
        if not ready:
            raise ValueError("a circle of jobs")
        out += ready
    return out


def run_chain(first: str, job: dict, steps: Mapping[str, Callable[[dict], Any]], chain: Mapping[str, Sequence[str]] = CHAIN) -> dict[str, Any]:
    """Runs a step, when it has ended those that come after it, and so on, each once; (name -> what it returned). A step that raises
    ends what follows it, and no others: its result is the exception."""
    out: dict[str, Any] = {}
    wanted = {first}
    for name in order(chain):
        if name not in wanted:
            continue
        try:
            out[name] = steps[name](job)
        except Exception as e:  # noqa: BLE001  the others go on
            out[name] = e
            continue
        wanted.update(chain.get(name, ()))
    return out


def on_changed(upserted: DataFrame, hook: Callable[[DataFrame], None]) -> bool:
    """Calls a hook with the documents of history.upsert() that were stored with changes, if there are any."""
    changed = upserted.where("error is null and size(changes) > 0")
    if not changed.limit(1).count():
        return False
    hook(changed)
    return True


class Results:
    """Results by key that are made again when they are too old. A frame is kept in the executors' memory or on their disks till then."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self.kept: dict[Hashable, tuple[float, DataFrame]] = {}

    def get(self, key: Hashable, seconds: float, make: Callable[[], DataFrame]) -> DataFrame:
        made = self.kept.get(key)
        if made and self.clock() - made[0] < seconds:
            return made[1]
        if made:
            made[1].unpersist()
        df = make().persist()
        self.kept[key] = (self.clock(), df)
        return df
