"""Change logs as rows and as text."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.cdc.diff import Change, item, string_path

LONG = ("summary", "text")


def exploded(docs: DataFrame, key: str, changes: str = "changes") -> DataFrame:
    """(key, ts, seq, type, path, data): one row a change of a table's change logs."""
    log = docs.select(F.col(key).alias("key"), F.explode(changes).alias("ts", "list"))
    return log.select("key", "ts", F.posexplode("list").alias("seq", "c")).select("key", "ts", "seq", "c.*")


def names_only(path: Column) -> Column:
    """A path without list indexes, which are written #n."""
    return F.filter(path, lambda p: ~p.rlike("^#[0-9]+$"))


def dotted(path: Column) -> Column:
    return F.array_join(names_only(path), ".")


def under(history: DataFrame, prefix: Sequence[str]) -> DataFrame:
    """The changes whose path, list indexes apart, begins with a prefix."""
    plain = names_only(F.col("path"))
    return history.where(F.slice(plain, 1, len(prefix)) == F.array(*map(F.lit, prefix))) if prefix else history


def summaries(history: DataFrame) -> DataFrame:
    """(key, ts, summary): the distinct dotted paths of each time, comma-joined in order."""
    paths = history.select("key", "ts", dotted(F.col("path")).alias("p")).distinct().groupBy("key", "ts")
    return paths.agg(F.array_join(F.array_sort(F.collect_list("p")), ", ").alias("summary"))


def filter_options(history: DataFrame) -> DataFrame:
    """(key, path): what a history can be filtered by, without regard to case in order."""
    return history.select("key", dotted(F.col("path")).alias("path")).distinct().orderBy("key", F.lower("path"))


def aliases_from_history(members: DataFrame, history: DataFrame) -> DataFrame:
    """(key, aliases): a person's aliases with the full names that the change log says they had before."""
    old = history.where((F.array_join("path", ".") == "Name.full") & (F.col("type") == "changed"))
    before = old.select("key", F.get_json_object("data", "$[0]").alias("name")).groupBy("key").agg(F.collect_set("name").alias("__old"))
    joined = members.join(before, members.UserID == before.key, "left")
    return joined.select(F.col("UserID").alias("key"), F.array_union("Name.aliases", F.coalesce("__old", F.array().cast("array<string>"))).alias("aliases"))


def value_and_changes(doc: Mapping, path: list) -> tuple[object, list[tuple[str, Change]]]:
    """What stands at a path now, and (time, change) of all changes under it, the latest first."""
    log = doc.get("changes") or {}
    names = string_path(path)
    found = [(ts, c) for ts in sorted(log, reverse=True) for c in log[ts] if string_path(c["path"])[: len(names)] == names]
    return item(doc, path), found


def tree(changes: Sequence[Change]) -> dict:
    """Changes by their path, as nested dicts; a change stands in the list under the empty key."""
    out: dict = {}
    for c in changes:
        at = out
        for step in c["path"]:
            at = at.setdefault(step, {})
        at.setdefault("", []).append(c)
    return out


def _shown(value: object, name: object) -> str:
    text = str(value)
    return text if name not in LONG or len(text) < 80 else text[:77] + "..."


def lines(changes: Sequence[Change]) -> list[str]:
    """One line a change, in order."""
    out = []
    for c in changes:
        path, last = ".".join(map(str, c["path"])), c["path"][-1] if c["path"] else None
        if c["type"] == "changed":
            out.append(f"changed {path}: {_shown(c['data'][0], last)} -> {_shown(c['data'][1], last)}")
        else:
            out.append(f"{c['type']} {path}: {_shown(c['data'], last)}")
    return out


def nested_lines(changes: Sequence[Change]) -> list[str]:
    """Indented by path, each part of a path once."""
    out: list[str] = []

    def walk(node: Mapping, depth: int) -> None:
        for c in node.get("", ()):
            mark = {"added": "+", "deleted": "-", "changed": "~"}[c["type"]]
            body = f"{c['data'][0]} -> {c['data'][1]}" if mark == "~" else str(c["data"])
            out.append("  " * depth + f"{mark} {body}")
        for step, below in node.items():
            if step != "":
                out.append("  " * depth + f"{step}:")
                walk(below, depth + 1)

    walk(tree(changes), 0)
    return out


def as_html(changes: Sequence[Change]) -> str:
    """A list with <ins> and <del>."""
    out = []
    for c in changes:
        path = html.escape(".".join(map(str, c["path"])))
        old = c["data"][0] if c["type"] == "changed" else c["data"] if c["type"] == "deleted" else None
        new = c["data"][1] if c["type"] == "changed" else c["data"] if c["type"] == "added" else None
        parts = [f"<del>{html.escape(str(old))}</del>" if old is not None else "", f"<ins>{html.escape(str(new))}</ins>" if new is not None else ""]
        out.append(f"<li>{path} {''.join(parts)}</li>")
    return f"<ul>{''.join(out)}</ul>"


# The parts of a rendered change log, by template.
_PARTS = ("added", "deleted", "changed", "indent", "header", "footer", "open", "close", "key", "key_end", "value", "value_end", "title", "title_end")
TEMPLATES = {
    name: dict(zip(_PARTS, parts, strict=True))
    for name, parts in {
        "ansi": ("\033[32m%s\033[0m", "\033[31m%s\033[0m", "\033[31m%s\033[32m%s\033[0m", "   ", "", "", "", "", "", ": ", "", "", "", ""),
        "semantic": (
            "<ins>%s</ins>", "<del>%s</del>", "<del>%s</del><ins>%s</ins>", "", '<div class="ui grid container padded diff">', "</div>", '<div class="ui grid container">', "</div>",
            '<div class="two wide column">', "</div>", '<div class="fourteen wide column">', "</div>", '<div class="sixteen wide column">\n', "</div>",
        ),
        "table": (
            "<ins>%s</ins>\n", "<del>%s</del>\n", "<del>%s</del>\n<ins>%s</ins>\n", "", '<div class="ui container diff">\n', "</div>\n", '<table class="ui table">\n', "</table>\n",
            "<tr>\n<td>\n", "</td>\n", "<td>\n", "</td>\n</tr>\n", '<tr>\n<th colspan="2">\n', "</th></tr>\n",
        ),
        "mail": (
            "<ins>%s</ins>\n", "<del>%s</del>\n", '<div class="changed row"><del class="column">%s</del>\n<ins class="column">%s</ins></div>\n', "", '<div class="wrapper">\n', "</div>\n",
            '<table class="table">\n', "</table>\n", '<tr class="key">\n<td class="td">\n', "</td>\n", '<td class="td">\n', "</td>\n</tr>\n", '<tr>\n<th colspan="2">\n', "</th></tr>\n",
        ),
    }.items()
}


def rendered(changes: Sequence[Change], template: str = "ansi") -> str:
    """Changes as nested parts of a template: a title for each part of a path, a key and values where changes stand. Values
    are escaped in all but the first template."""
    t = TEMPLATES[template]
    shown = str if template == "ansi" else lambda v: html.escape(str(v))
    out: list[str] = [t["header"]]

    def body(c: Change) -> str:
        return t["changed"] % (shown(c["data"][0]), shown(c["data"][1])) if c["type"] == "changed" else t[c["type"]] % shown(c["data"])

    def walk(node: Mapping, depth: int) -> None:
        pad = t["indent"] * depth
        for step in sorted((k for k in node if k != ""), key=str):
            below = node[step]
            if set(below) == {""}:
                out.extend([pad, t["key"], shown(step), t["key_end"], t["value"], "".join(map(body, below[""])), t["value_end"], "\n" if template == "ansi" else ""])
            else:
                out.extend([pad, t["title"], shown(step), t["title_end"], "\n" if template == "ansi" else "", t["open"]])
                out.extend(body(c) for c in below.get("", ()))
                walk(below, depth + 1)
                out.append(t["close"])

    root = tree(changes)
    out.extend(body(c) for c in root.get("", ()))
    out.append(t["open"])
    walk(root, 0)
    out += [t["close"], t["footer"]]
    return "".join(out)
