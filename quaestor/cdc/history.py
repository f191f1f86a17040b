"""History of documents: upsert with a change log, time travel, flat snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.cdc.diff import Mismatch, diff, patch, revert, same, summary, without_nulls

UNTRACKED = ("meta", "changes", "_id")


def not_empty(doc: dict) -> dict:
    """A document without falsy entries; 0 and False stay."""
    return {k: v for k, v in doc.items() if v or v is False or (v == 0 and isinstance(v, (int, float)))}


def upserted(previous: dict | None, doc: dict, now: str, nopreserve: Sequence[str] = (), tracked: bool = True) -> tuple[dict | None, list]:
    """(what to store, its changes); nothing to store: None. Top-level fields that are gone stay, unless they are in
    nopreserve or were empty. Raises Mismatch if the changes, applied, don't give the document."""
    doc = without_nulls(not_empty(doc))
    changes = {}
    if previous is not None:
        before = without_nulls({k: v for k, v in previous.items() if k not in UNTRACKED})
        after = {k: v for k, v in doc.items() if k not in UNTRACKED}
        changes = dict(previous.get("changes") or {})
        if not tracked:
            found = []
        else:
            for k, v in before.items():
                if k not in after and k not in nopreserve and v not in ({}, []):
                    after[k] = v
            found = diff(before, after)
            if not found:
                return None, []
            if not same(without_nulls(patch(before, found)), without_nulls(after)):
                raise Mismatch("the changes don't give the document")
        meta = {**(previous.get("meta") or {}), **(doc.get("meta") or {}), "updated": now}
        doc = after
    else:
        found = []
        meta = {**(doc.pop("meta", None) or {}), "created": now}
    if found:
        changes[now] = found
    return {**doc, "meta": meta, "changes": changes}, found


def upsert(previous: DataFrame, docs: DataFrame, now: str, key: str = "key", doc: str = "doc", nopreserve: Sequence[str] = ()) -> DataFrame:
    """(key, doc, changes, error): the table after an upsert. Both sides are (key, JSON text); the last of repeated keys of
    docs is meant to be chosen before. error: why a document was refused; the previous one then stays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, old, new in zip(f["key"], f["old"], f["new"], strict=True):
                found, error, kept = [], None, old
                if new is not None:
                    try:
                        stored, found = upserted(json.loads(old) if old else None, json.loads(new), now, nopreserve)
                        kept = json.dumps(stored, ensure_ascii=False, sort_keys=True) if stored is not None else old
                    except (Mismatch, ValueError) as e:
                        error = str(e) or "mismatch"
                out.append((k, kept, json.dumps(found, ensure_ascii=False), error))
            yield pd.DataFrame(out, columns=["key", "doc", "changes", "error"])

    left = previous.select(F.col(key).cast("string").alias("key"), F.col(doc).alias("old"))
    right = docs.select(F.col(key).cast("string").alias("key"), F.col(doc).alias("new"))
    return left.join(right, "key", "full_outer").mapInPandas(run, "key string, doc string, changes string, error string")


def as_of(doc: dict, date: str) -> tuple[dict, str | None, list[tuple[str, str]]]:
    """(document at a date, the change that couldn't be reverted, [(time, summary)] still in the log). The oldest change is never
    reverted; those at or after the date are, the latest first."""
    doc = json.loads(json.dumps(doc))
    log = doc.get("changes") or {}
    failed = None
    for ts in sorted(log, reverse=True)[:-1]:
        if date > ts:
            break
        if log[ts]:
            try:
                back = revert({k: v for k, v in doc.items() if k != "changes"}, log[ts])
            except Mismatch:
                failed = ts
                break
            doc = {**back, "changes": log}
        del log[ts]
    return doc, failed, [(ts, summary(c)) for ts, c in sorted(log.items(), reverse=True)]


def travelled(docs: DataFrame, date: str, key: str = "key", doc: str = "doc") -> DataFrame:
    """(key, doc, failed_at) of JSON documents as of a date."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, d in zip(f["key"], f["doc"], strict=True):
                back, failed, _ = as_of(json.loads(d), date) if d else (None, None, [])
                out.append((k, json.dumps(back, ensure_ascii=False, sort_keys=True) if d else None, failed))
            yield pd.DataFrame(out, columns=["key", "doc", "failed_at"])

    return docs.select(F.col(key).cast("string").alias("key"), F.col(doc).alias("doc")).mapInPandas(run, "key string, doc string, failed_at string")


def changes(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with a column changes: array of (type, path, data as JSON); list indexes in a path are written #n."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for a, b in zip(f[old], f[new], strict=True):
                c = diff(json.loads(a) if a else None, json.loads(b) if b else None)
                found.append([{"type": x["type"], "path": [f"#{p}" if isinstance(p, int) else p for p in x["path"]], "data": json.dumps(x["data"], ensure_ascii=False)} for x in c])
            yield f.assign(changes=found)

    return pairs.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", changes array<struct<type:string,path:array<string>,data:string>>")


def state_as_of(log: DataFrame, key: Sequence[str], value: str, ts: str, date, tie: str) -> DataFrame:
    """The last value of each key before a date, from a flat change log; native."""
    return log.where(F.col(ts) < date).groupBy(*key).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, type, old, new) of flat rows, native: a full outer join, then one row per column that differs."""
    a = old.select(key, *(F.col(c).cast("string").alias(f"__o_{c}") for c in columns))
    b = new.select(key, *(F.col(c).cast("string").alias(f"__n_{c}") for c in columns))
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"__o_{c}").alias("old"), F.col(f"__n_{c}").alias("new")) for c in columns)))
    rows = a.join(b, key, "full_outer").select(key, fields.alias("f")).select(key, "f.*").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("changed")
    return rows.select(key, "field", kind.alias("type"), "old", "new")
