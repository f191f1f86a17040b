"""Schema profile of untyped JSON documents."""

from __future__ import annotations

import html
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame, doc: str) -> DataFrame:
    """(key, type, n, percent) of the top level of JSON objects, native: how many documents have a key with a type.
    percent: of all rows of df. Types are those of VARIANT; strings of white space count as null."""
    v = F.try_parse_json(F.col(doc))
    rows = df.select(F.explode(F.from_json(F.col(doc), "map<string,string>")).alias("key", "raw"), v.alias("v"))
    value = F.try_parse_json("raw")
    # from_json unquotes strings: what doesn't parse, or stood in quotes, is one
    kind = F.when(F.col("raw").isNull() | (F.trim("raw") == ""), "null").otherwise(F.lower(F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("STRING")), r"^\w+", 0)))
    total = df.agg(F.count("*").alias("total"))
    counted = rows.select("key", kind.alias("type")).groupBy("key", "type").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("key", "type", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))


def _kind(value) -> str:
    if value is None or isinstance(value, str) and not value.strip():
        return "null"
    return {bool: "bool", int: "int", float: "float", str: "str", list: "list", dict: "dict"}[type(value)]


def _walk(value, path: str, seen: Counter, lengths: Counter, examples: dict) -> None:
    kind = _kind(value)
    seen[path, kind] += 1
    if value and (path, kind) not in examples:
        examples[path, kind] = json.dumps(value, ensure_ascii=False)[:200]
    if kind == "dict":
        for k, v in value.items():
            _walk(v, f"{path}.{k}" if path else k, seen, lengths, examples)
    elif kind == "list":
        lengths[path] += len(value)
        for v in value:
            _walk(v, f"{path}[]", seen, lengths, examples)


def nested(df: DataFrame, doc: str) -> DataFrame:
    """(path, type, n, percent, example) of whole documents. Elements of a list are at path[]; percent is of the
    parent's number, for a list 100 times its mean length. Tasks add up before anything is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen, lengths, examples = Counter(), Counter(), {}
            for text in f["doc"]:
                if text is not None:
                    _walk(json.loads(text), "", seen, lengths, examples)
            yield pd.DataFrame(
                [(p, k, n, lengths[p] if k == "list" else 0, examples.get((p, k))) for (p, k), n in seen.items()], columns=["path", "type", "n", "items", "example"]
            )

    rows = df.select(F.col(doc).cast("string").alias("doc")).mapInPandas(run, "path string, type string, n long, items long, example string")
    found = rows.groupBy("path", "type").agg(F.sum("n").alias("n"), F.sum("items").alias("items"), F.min("example").alias("example"))
    parent = F.regexp_replace("path", r"(\[\]|(^|\.)[^.\[\]]*)$", "")
    totals = found.groupBy(F.col("path").alias("__parent")).agg(F.sum(F.when(F.col("type").isin("dict", "list"), F.col("n"))).alias("__n"))
    joined = found.withColumn("__parent", parent).join(totals, "__parent", "left")
    percent = F.when(F.col("type") == "list", 100.0 * F.col("items") / F.col("n")).otherwise(100.0 * F.col("n") / F.coalesce("__n", "n"))
    return joined.select("path", "type", "n", percent.alias("percent"), "example")


def drop_empty(column: Column) -> Column:
    """A map without entries that are null or empty; 0 and false survive."""
    return F.map_filter(column, lambda k, v: v.isNotNull() & (F.trim(v) != "") & ~v.isin("[]", "{}"))


def report(profile: DataFrame, title: str) -> str:
    """nested()'s rows as an HTML page: each path under its parent with types, percentages and an example. A profile is as large
    as the schema, not as the table."""
    rows = sorted(profile.collect(), key=lambda r: (r.path, -r.n, r.type))
    lines = [f"<h1>Schema of the {html.escape(title)} dataset</h1>", '<div class="schema-legend">Percentages show probability of this field appearing under its parent; of lists, 100 times their mean length.</div>', "<ul>"]
    for r in rows:
        depth = r.path.count(".") + r.path.count("[]")
        lines.append(f'<li style="margin-left:{depth}em"><b>{html.escape(r.path or "(document)")}</b> {r.type} {r.percent:.2f}% <code>{html.escape(r.example or "")}</code></li>')
    return "\n".join([*lines, "</ul>"])


def reports(df: DataFrame, doc: str, title: str, split: str | None = None) -> dict[str, str]:
    """Reports by name. split: documents last updated (else created) after that time are the title's, those before it are title_v1's."""
    if split is None:
        return {title: report(nested(df, doc), title)}
    at = F.coalesce(F.get_json_object(doc, "$.meta.updated"), F.get_json_object(doc, "$.meta.created"))
    return {name: report(nested(df.where(part), doc), title) for name, part in ((title, at > split), (f"{title}_v1", at < split))}
