"""Subscriptions: who is told of a change, and what expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SENT_ROWS, SENT_BYTES = 50_000, 4 << 20  # items, or subscribers, that may be sent to every task


def _sent(rows: int, size: int | None, most: int) -> str:
    """The hint of a join with so many rows, whose strings have so many bytes."""
    return "broadcast" if rows <= most and (size or 0) <= SENT_BYTES else "merge"


def recipients(changed: DataFrame, items: DataFrame, subscribers: DataFrame, text: list[Column] | None = None, most: int = SENT_ROWS) -> DataFrame:
    """(key, email), each once. changed: (key, subjects array, and columns that `text` reads); items and
    subscribers with a pending activation key don't count. An item matches by name = key, by a subject's name
    (type subject or subjects), or, of type search, if one text field holds all its terms.

    The changed rows are never sent to the driver: items, and subscribers, are sent to every task if they are counted as
    at most `most`, else both sides are shuffled. Results don't depend on `most`."""
    live = items.where(F.col("activation_key").isNull() | (F.col("activation_key") == ""))
    who = subscribers.where(F.col("activation_key").isNull() | (F.col("activation_key") == "")).select("group_id", "email")
    terms = F.split(F.trim(F.lower("name")), r"\s+")
    longest = F.array_max(F.transform(terms, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t
    gram = F.when(F.expr("type = 'search' and trim(name) <> ''"), F.left(longest, F.lit(3)))
    # sizes of the searches' first characters: of 1, 2 and 3, mostly 3 alone
    rows, size, sizes = live.agg(F.count("*"), F.sum(F.octet_length("name")), F.collect_set(F.length(gram))).first()
    how = _sent(rows, size, most)
    told = _sent(*who.agg(F.count("*"), F.sum(F.octet_length("email"))).first(), most)
    by_key = changed.join(live.hint(how), changed.key == live.name).select("key", "group_id")
    subject = changed.select("key", F.explode("subjects").alias("__s"))
    by_subject = subject.join(live.where(F.col("type").isin("subject", "subjects")).hint(how), F.col("__s") == F.col("name")).select("key", "group_id")
    out = by_key.union(by_subject)
    if text and sizes:
        # all terms of a search must be in one line of a field. A search meets only the rows that hold the first characters of
        # its longest term anywhere, by a join; then its terms are looked for
        searches = live.where(gram.isNotNull()).select(terms.alias("__terms"), F.col("group_id").alias("__group"), gram.alias("__gram"))
        lines = F.flatten(F.array(*(F.split(F.lower(F.coalesce(t, F.lit(""))), "\n") for t in text)))

        def grams(line: Column) -> Column:
            none = F.array().cast("array<string>")

            def of(n: int) -> Column:
                places = F.sequence(F.lit(1), F.greatest(F.length(line) - n + 1, F.lit(1)))
                return F.when(F.length(line) >= n, F.transform(places, lambda i: F.substr(line, i, F.lit(n)))).otherwise(none)

            return F.concat(none, *map(of, sorted(sizes)))

        texts = changed.select("key", lines.alias("__lines"))
        held = texts.select("key", "__lines", F.explode(F.array_distinct(F.flatten(F.transform("__lines", grams)))).alias("__gram"))
        if how == "merge":  # lines aren't shuffled once for each of their grams: they meet the searches again by key
            met = held.drop("__lines").join(searches.hint(how), "__gram").select(F.col("key").alias("__key"), "__terms", "__group").distinct()
            rows = texts.join(met.hint(how), F.col("key").eqNullSafe(F.col("__key")))
        else:
            rows = held.join(searches.hint(how), "__gram")
        rows = rows.select("key", "__lines", F.struct("__terms", "__group").alias("s"))
        hit = F.exists("__lines", lambda line: F.forall("s.__terms", lambda t: F.contains(line, t)))
        out = out.union(rows.where(hit).select("key", F.col("s.__group")))
    return out.join(who.hint(told), "group_id").select("key", "email").distinct()


def expired(rows: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Pending rows that are over `days` days old."""
    pending = F.col("activation_key").isNotNull() & (F.col("activation_key") != "")
    return rows.where(pending & (F.col("added") < F.date_sub(today, days)))


def remaining_groups(groups: DataFrame, *members: DataFrame) -> DataFrame:
    """The groups that still have a member."""
    out = members[0].select("group_id")
    for m in members[1:]:
        out = out.union(m.select("group_id"))
    return groups.join(out.distinct(), F.col("id") == F.col("group_id"), "left_semi")


def notices(matched: DataFrame, diffs: DataFrame) -> DataFrame:
    """(recipient, subject, body), one row a mail: (key, email) of recipients() with (key, title, body) of what changed."""
    return matched.join(diffs, "key").select(F.col("email").alias("recipient"), F.concat(F.col("key"), F.lit(" "), F.col("title")).alias("subject"), "body")


def group_page(items: DataFrame, group: int) -> DataFrame:
    """(state, type, names): a group's subscriptions, active or pending, by type."""
    pending = F.col("activation_key").isNotNull() & (F.col("activation_key") != "")
    rows = items.where(F.col("group_id") == group).select(F.when(pending, "pending").otherwise("active").alias("state"), "type", "name")
    return rows.groupBy("state", "type").agg(F.array_sort(F.collect_list("name")).alias("names"))
