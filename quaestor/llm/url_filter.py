"""URL filter: given rules first, mined association rules for the rest; DataFrame and SQL functions only.

Given rules: (host, path prefix, verdict); the longest that fits decides. Other urls are judged by rules
that FP-growth mines from labelled urls: token combinations (host parts, their words, path parts, names
of query fields) that imply a block with at least the given confidence and support. What is left out before the
mining changes no rule: tokens with fewer blocks than the support; all but one of the tokens that stand in the
same labelled urls (rules get each of them back); tokens that are rules alone or stand in every url, as a longer rule
with one blocks nothing more. Urls bring all their other tokens, and every rule that contains no other is kept.
Rules match through an inverted index: distinct urls' tokens are joined with each rule's rarest token, and the rules met so
are verified. A url is blocked if it holds all tokens of one; without a match it is allowed.

Nulls: a null url or one without :// has empty host and path, no tokens, and is allowed. Repeated rows are
judged each. Null labels don't count; of several labels of an id a block counts. Without labels nothing is mined."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import written

SUPPORT = 20
CONFIDENCE = 0.8
ALLOW, BLOCK = "allow", "block"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a url, in order: h: host parts, w: their words, d: registered name, p: path parts, q: names
    of query fields; digits in a row count as one."""
    names = F.filter(F.split(host(url), r"\."), lambda t: t != "")
    words = F.filter(F.flatten(F.transform(names, lambda t: F.split(t, "[-_]"))), lambda t: t != "")
    domain = F.when(F.size(names) > 1, F.array(F.concat(F.element_at(names, -2), F.lit("."), F.element_at(names, -1)))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.split(F.regexp_replace(lower_ascii(path(url)), "[0-9]+", "0"), "[/.]"), lambda t: t != "")
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    fields = F.filter(F.transform(F.split(query, "&"), lambda f: F.substring_index(f, "=", 1)), lambda t: t != "")

    def marked(mark: str, found: Column) -> Column:
        return F.transform(found, lambda t: F.concat(F.lit(mark), t))

    every = F.concat(marked("h:", names), marked("w:", words), marked("d:", domain), marked("p:", parts), marked("q:", fields))
    return F.array_sort(F.array_distinct(F.coalesce(every, F.array().cast("array<string>"))))


def given(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits, else null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    h, p = host(url), path(url)
    fits = [
        F.when(((h == name) | h.endswith("." + name)) & p.startswith(start), F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")))
        for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    ]
    return F.coalesce(*fits)


def mined(pages: DataFrame, labels: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """(tokens, lead, confidence, n) of the rules that imply a block and contain no other such rule; lead is the rarest
    token, n the support. None without a block. pages: (id, url); labels: (id, blocked)."""
    marks = labels.where("id is not null and blocked is not null").groupBy("id").agg(F.max(F.col("blocked").cast("int")).alias("blocked"))
    labelled = pages.where("url is not null").join(marks, "id")
    rows = written(labelled.select(F.monotonically_increasing_id().alias("row"), "blocked", tokens(F.col("url")).alias("tokens")))
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if not bad:
        return None
    sums = [F.sum(F.xxhash64(F.lit(i), "tokens").cast("decimal(20,0)")).alias(f"sum{i}") for i in (1, 2)]  # of the urls that hold a token
    alone = rows.select("blocked", "tokens", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum("blocked").alias("bad"), *sums)
    alike = alone.where(F.col("bad") >= support).groupBy("n", "bad", "sum1", "sum2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    classes = written(alike.select(F.element_at("members", 1).alias("item"), "members", "n", "bad", (F.col("bad") / F.col("n")).alias("confidence")))
    single = classes.where(F.col("confidence") >= confidence).select(F.explode("members").alias("lead"), "confidence", F.col("bad").alias("n"))
    single = single.select(F.array("lead").alias("tokens"), "lead", "confidence", "n")
    rest = classes.where((F.col("confidence") < confidence) & (F.col("n") < total))
    held = rows.select("row", "blocked", F.explode("tokens").alias("item")).join(rest.select("item"), "item")
    block = F.when(F.max("blocked") == 1, F.array(F.lit("y:block"))).otherwise(F.array().cast("array<string>"))
    baskets = written(held.groupBy("row").agg(F.concat(F.collect_list("item"), block).alias("items")).select("items"))
    count = baskets.count()
    if not count:
        return single
    # half a row less, as the share times the count may come out above the support
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support - 0.5, 0.5) / count)).fit(baskets)
    sets = written(model.freqItemsets)
    blocked = sets.where(F.array_contains("items", "y:block") & (F.size("items") > 2)).select(F.array_sort(F.array_remove("items", "y:block")).alias("items"), F.col("freq").alias("bad"))
    every = sets.where(~F.array_contains("items", "y:block") & (F.size("items") > 1)).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    share = (F.col("bad") / F.col("n")).alias("confidence")
    found = blocked.join(every, "items").where((F.col("bad") >= support) & (share >= confidence)).select("items", share, F.col("bad").alias("n"))
    parts = found.select("items", "confidence", "n", F.explode("items").alias("item")).join(rest.select("item", "members", F.col("n").alias("often")), "item")
    rules = written(parts.groupBy("items", "confidence", "n").agg(F.min(F.struct("often", "item")).alias("lead"), F.collect_list(F.transform("members", lambda t: F.struct("often", t.alias("token")))).alias("members")))
    within = rules.select(F.col("lead.item").alias("part"), F.col("items").alias("less"))
    holds = (F.size("less") < F.size("items")) & (F.size(F.array_except("less", "items")) == 0)
    longer = rules.select("items", F.explode("items").alias("part")).join(within, "part").where(holds).select("items").distinct()
    none = F.array().cast("array<struct<often:bigint,token:string>>")
    choices = F.aggregate("members", F.array(none), lambda made, some: F.flatten(F.transform(made, lambda m: F.transform(some, lambda t: F.concat(m, F.array(t))))))
    several = rules.join(longer, "items", "left_anti").select("confidence", "n", F.explode(choices).alias("chosen"))
    return single.union(several.select(F.array_sort(F.col("chosen.token")).alias("tokens"), F.array_min("chosen").token.alias("lead"), "confidence", "n"))


def mine(pages: DataFrame, labels: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[list[str], float, int]]:
    """mined() as a list, for a look at it. The strongest come first; ties go to more support, then to fewer and earlier tokens."""
    found = mined(pages, labels, support, confidence)
    kept = [(list(r.tokens), r.confidence, r.n) for r in found.collect()] if found is not None else []
    return sorted(kept, key=lambda k: (-k[1], -k[2], len(k[0]), k[0]))


def joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): the tokens of the first rule of mined() that a url of column url holds all tokens of, by a join on
    the rules' rarest tokens; urls without one are left out."""
    held = urls.where("url is not null").select("url").distinct().select("url", F.explode(tokens(F.col("url"))).alias("lead"))
    hits = held.join(rules, "lead").where(F.size(F.array_except("tokens", tokens(F.col("url")))) == 0)
    first = F.min(F.struct(-F.col("confidence"), -F.col("n"), F.size("tokens"), "tokens"))
    return hits.groupBy("url").agg(first.alias("first")).select("url", F.array_join("first.tokens", " ").alias("mined"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, host, path, rule, mined, verdict) for each row of pages. labels: (id, blocked). mined: the tokens of the
    mined rule that blocked it, where no given rule fits. Empty pages give no rows; columns but the two named aren't read."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    found = mined(rows, labels, support, confidence)
    learned = written(found) if found is not None else None
    if learned is not None and learned.limit(1).count():
        out = rows.join(joined(rows, learned).withColumnRenamed("mined", "hit"), "url", "left")
    else:
        out = rows.withColumn("hit", F.lit(None).cast("string"))
    out = out.withColumn("given", given(F.col("url"), rules))
    by_mining = F.when(F.col("given").isNull(), F.col("hit"))
    return out.select(
        "id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("given.rule").alias("rule"), by_mining.alias("mined"),
        F.coalesce(F.col("given.verdict"), F.when(F.col("hit").isNotNull(), BLOCK).otherwise(ALLOW)).alias("verdict"),
    )
