"""Change data: snapshots, time travel, upserts, subscriptions, streams, parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.cdc import history
from quaestor.functions import text
from quaestor.operators import subs
from quaestor.plans.registry import Tables, query
from quaestor.shared import place
from quaestor.streaming import jobs


@query("""select user_id, event_type, arg_max(event_id, (epoch_us(ts), event_id)) as event_id, max(ts) as ts from events where ts < timestamp '2024-01-15' group by 1, 2""")
def as_of_state(t: Tables) -> DataFrame:
    return history.state_as_of(t.events, ["user_id", "event_type"], "event_id", "ts", F.to_timestamp(F.lit("2024-01-15")), "event_id")


@query("""with o as (select c_custkey, c_name, c_mktsegment from customer where c_custkey % 11 <> 0),
n as (select c_custkey, case when c_custkey % 7 = 0 then upper(c_name) || '!' else c_name end as c_name, case when c_custkey % 13 = 0 then null else c_mktsegment end as c_mktsegment from customer where c_custkey % 17 <> 0),
j as (select coalesce(o.c_custkey, n.c_custkey) as c_custkey, o.c_name as a1, n.c_name as b1, o.c_mktsegment as a2, n.c_mktsegment as b2 from o full outer join n using (c_custkey)),
f as (select c_custkey, 'c_name' as field, a1 as old, b1 as new from j union all select c_custkey, 'c_mktsegment', a2, b2 from j)
select c_custkey, field, case when old is null then 'added' when new is null then 'deleted' else 'changed' end as type, old, new from f where old is distinct from new""")
def snapshot_diff(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name"))
    new = c.where(k % 17 != 0).select("c_custkey", name.alias("c_name"), F.when(k % 13 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return history.snapshot_diff(c.where(k % 11 != 0), new, "c_custkey", ["c_name", "c_mktsegment"])


@query("""with items as (select * from (values ('5', 'dossier', 1, null), ('PROMO', 'subject', 1, ''), ('PROMO', 'subjects', 2, null), ('ring small', 'search', 3, null), ('9', 'dossier', 2, 'pending')) i(name, type, group_id, activation_key)),
people as (select * from (values (1, 'a@example.org', null), (2, 'b@example.org', ''), (3, 'c@example.org', null), (3, 'd@example.org', 'pending')) p(group_id, email, activation_key)),
live as (select * from items where coalesce(activation_key, '') = ''), who as (select * from people where coalesce(activation_key, '') = ''),
hits as (select p_partkey::varchar as key, group_id from part join live on name = p_partkey::varchar
union all select p_partkey::varchar, group_id from part join live on type in ('subject', 'subjects') and list_contains(string_split(p_type, ' '), name)
union all select p_partkey::varchar, group_id from part join live on type = 'search' and contains(lower(p_name), 'ring') and contains(lower(p_name), 'small'))
select distinct key, email from hits join who using (group_id)""")
def subscription_match(t: Tables) -> DataFrame:
    items = [("5", "dossier", 1, None), ("PROMO", "subject", 1, ""), ("PROMO", "subjects", 2, None), ("ring small", "search", 3, None), ("9", "dossier", 2, "pending")]
    people = [(1, "a@example.org", None), (2, "b@example.org", ""), (3, "c@example.org", None), (3, "d@example.org", "pending")]
    changed = t.part.select(F.col("p_partkey").cast("string").alias("key"), F.split("p_type", " ").alias("subjects"), "p_name")
    items_df = t.spark.createDataFrame(items, "name string, type string, group_id int, activation_key string")
    people_df = t.spark.createDataFrame(people, "group_id int, email string, activation_key string")
    return subs.recipients(changed, items_df, people_df, [F.col("p_name")])


@query("""select o_orderkey from orders where o_orderstatus = 'P' and o_orderdate::date < date '1998-01-01' - 7""")
def ttl_expire(t: Tables) -> DataFrame:
    key = F.when(F.col("o_orderstatus") == "P", "pending")
    rows = t.orders.select("o_orderkey", key.alias("activation_key"), F.to_date("o_orderdate").alias("added"))
    return subs.expired(rows, F.lit("1998-01-01").cast("date")).select("o_orderkey")


def _documents(t: Tables, later: bool) -> DataFrame:
    k = F.col("p_partkey")
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    size = F.when((k % 3 == 0) & F.lit(later), F.col("p_size") + 1).otherwise(F.col("p_size"))
    tags = F.when((k % 5 == 0) & F.lit(later), F.reverse(words)).otherwise(words)
    doc = F.to_json(F.struct(F.col("p_name").alias("name"), size.alias("size"), tags.alias("tags"), F.struct("p_brand", "p_retailprice").alias("about")))
    return t.part.select(k.cast("string").alias("key"), doc.alias("doc"))


# the documents' two states and the changes between them; each is written as the log and as a column write it
_STATES = """p as (select p_partkey as k, p_name, p_size, p_brand, p_retailprice, string_split(p_name || ' ' || p_type, ' ') as w from part),
q as (select *, k % 3 = 0 as sized, case when k % 5 = 0 then list_reverse(w) else w end as v from p),
c as (select *, case when sized then p_size + 1 else p_size end as size, list_filter(range(1, len(w) + 1), lambda i: w[i] <> v[i]) as moved from q),
j as (select *, list_concat(case when sized then ['{"data": [' || p_size || ', ' || size || '], "path": ["size"], "type": "changed"}'] else [] end,
list_transform(moved, lambda i: '{"data": ["' || w[i] || '", "' || v[i] || '"], "path": ["tags", ' || (i - 1) || '], "type": "changed"}')) as logged,
list_concat(case when sized then ['{"type": "changed", "path": ["size"], "data": [' || p_size || ', ' || size || ']}'] else [] end,
list_transform(moved, lambda i: '{"type": "changed", "path": ["tags", ' || (i - 1) || '], "data": ["' || w[i] || '", "' || v[i] || '"]}')) as told from c)"""


def _stored(updated: str) -> str:
    """SQL of a document as it is stored after the second state, last written at a time."""
    return f"""'{{"about": {{"p_brand": "' || p_brand || '", "p_retailprice": ' || p_retailprice || '}}, "changes": {{'
|| case when len(logged) > 0 then '"2024-02-01T00:00:00": [' || array_to_string(logged, ', ') || ']' else '' end || '}}, "meta": {{"created": "2024-01-01T00:00:00"'
|| case when len(logged) > 0 then ', "updated": "{updated}"' else '' end || '}}, "name": "' || p_name || '", "size": ' || size || ', "tags": ["' || array_to_string(v, '", "') || '"]}}'"""


@query(f"""with {_STATES} select k::varchar as key, 'changed' as type, 'size' as path, '[' || p_size || ', ' || size || ']' as data from c where sized
union all select k::varchar, 'changed', 'tags.#' || (i - 1), '["' || w[i] || '", "' || v[i] || '"]' from (select *, unnest(moved) as i from c)""")
def nested_diff(t: Tables) -> DataFrame:
    old, new = _documents(t, False).withColumnRenamed("doc", "old"), _documents(t, True).withColumnRenamed("doc", "new")
    rows = history.changes(old.join(new, "key").where("old <> new"), "old", "new")  # equal texts have no changes
    return rows.select("key", F.explode("changes").alias("c")).select("key", "c.type", F.array_join("c.path", ".").alias("path"), "c.data")


@query(f"""with {_STATES} select k::varchar as key, {_stored("2024-02-01T00:00:00")} as doc, '[' || array_to_string(told, ', ') || ']' as changes, null::varchar as error from j""")
def upsert_with_history(t: Tables) -> DataFrame:
    first = history.upsert(_documents(t, False).limit(0), _documents(t, False), "2024-01-01T00:00:00")
    return history.upsert(first.select("key", "doc"), _documents(t, True), "2024-02-01T00:00:00")


@query(f"""with {_STATES} select k::varchar as key, {_stored("2024-03-01T00:00:00")} as doc, null::varchar as failed_at from j""")
def time_travel(t: Tables) -> DataFrame:
    first = history.upsert(_documents(t, False).limit(0), _documents(t, False), "2024-01-01T00:00:00").select("key", "doc")
    second = history.upsert(first, _documents(t, True), "2024-02-01T00:00:00").select("key", "doc")
    third = history.upsert(second, _documents(t, False), "2024-03-01T00:00:00").select("key", "doc")
    return history.travelled(third, "2024-02-15T00:00:00")


@query(r"""with m as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as s from pages)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as text from m""")
def html_text(t: Tables) -> DataFrame:
    """All text nodes of a page, white space collapsed; markup goes by pattern, as the page isn't well-formed XML."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(mark))
    return t.pages.select("page_id", text.collapse(plain).alias("text"))


@query("""with recursive e as (select user_id::varchar as source, row_number() over (partition by user_id order by event_id) as i, (event_type = 'error')::int as err from events),
s as (select distinct source, 0::bigint as i, []::int[] as outcomes, 0::bigint as trips from e
union all select source, i, case when list_sum(o) > 10 then []::int[] else o end, trips + (list_sum(o) > 10)::bigint
from (select s.source, e.i, list_append(s.outcomes, e.err)[-50:] as o, s.trips from s join e on e.source = s.source and e.i = s.i + 1))
select source, i as jobs, trips, coalesce(list_sum(outcomes), 0)::bigint as errors, 0 as batch from s qualify i = max(i) over (partition by source)""")
def stream_circuit_breaker(t: Tables) -> DataFrame:
    spark, at = t.spark, place(t.spark)
    stream = spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 8).parquet(f"{t.sf_dir}/events.parquet*")
    rows = stream.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("error"))
    jobs.run_available(jobs.breaker(rows), lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{at}/out"), f"{at}/state")
    return spark.read.schema(f"{jobs.OUT}, batch int").parquet(f"{at}/out")
