"""Aggregations: pivots, matrices, similarity, profiles, roll-ups, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import index, logs, lookup, matrix, profile, rollup, similarity
from quaestor.plans.registry import Tables, query

KINDS = ("view", "click", "purchase", "signup", "error")
SIGNS = {"plus": "F", "minus": "O", "zero": "P"}


@query("""with p as (select user_id, count(*) filter (event_type = 'view') as "view", count(*) filter (event_type = 'click') as click,
count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'error') as error
from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' group by user_id),
l as (select user_id, arg_max(event_type, event_id) as latest from (select *, rank() over (partition by user_id order by ts desc) as r from events) where r = 1 group by user_id)
select p.user_id, c_name, n_name, c_mktsegment, latest, "view", click, purchase, signup, error
from p join customer on c_custkey = p.user_id join nation on n_nationkey = c_nationkey join l on l.user_id = p.user_id""")
def activity_pivot_report(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", "ts")
    acts = e.where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-25'")
    latest = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    who = t.customer.join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = rollup.pivot_report(acts, "user_id", "event_type", KINDS).join(latest, "user_id").join(who, F.col("user_id") == F.col("c_custkey"))
    return out.select("user_id", "c_name", "n_name", "c_mktsegment", "latest", *KINDS)


@query("""with c as (select c_nationkey as k, bool_or(c_acctbal > 9000) as active, arg_min(c_name, c_custkey) as first from customer group by 1),
s as (select s_nationkey as k, count(*) as suppliers from supplier group by 1)
select coalesce(c.k, s.k) as k, active, first, suppliers from c full outer join s on c.k = s.k""")
def two_source_rollup(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.bool_or(F.col("c_acctbal") > 9000).alias("active"), F.min_by("c_name", "c_custkey").alias("first"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return rollup.two_sources(c, s, "k")


@query("""select distinct c_mktsegment, status from (select o_custkey, arg_max(o_orderstatus, o_orderkey) as status from orders group by 1) join customer on c_custkey = o_custkey""")
def last_element_distinct(t: Tables) -> DataFrame:
    lists = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return lists.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "status").distinct()


@query("""with u as (select user_id as k, event_type as type, strftime(ts, '%Y-%m-%d') as item from events
union all select o_custkey, 'order ' || o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') from orders)
select k, 'type' as facet, type as value, count(*) as n from u group by k, type union all select k, 'item', item, count(*) from u group by k, item""")
def multi_source_profile(t: Tables) -> DataFrame:
    day = "yyyy-MM-dd"
    return rollup.profile(
        [
            (t.events, F.col("user_id"), F.col("event_type"), F.date_format("ts", day)),
            (t.orders, F.col("o_custkey"), F.concat(F.lit("order "), "o_orderstatus"), F.date_format("o_orderdate", day)),
        ],
        "k",
    )


@query("""with n as (select user_id, event_type, count(*) as n from events where ts < timestamp '2024-01-20' group by 1, 2),
t as (select *, (sum(n) over (partition by user_id))::bigint as total from n),
p as (select user_id, row_number() over (order by total desc, user_id) as place from (select distinct user_id, total from t))
select t.user_id, event_type, n, total, place from t join p using (user_id)""")
def nested_group_order_by_total(t: Tables) -> DataFrame:
    return rollup.grouped_with_total(t.events.where("ts < timestamp'2024-01-20'").select("user_id", "event_type"), "user_id", "event_type")


def _ballots(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return t.orders.select("o_custkey", "o_orderstatus").join(c, F.col("o_custkey") == F.col("c_custkey"))


_TALLY = """count(*) filter (o_orderstatus = 'F') as plus, count(*) filter (o_orderstatus = 'O') as minus, count(*) filter (o_orderstatus = 'P') as zero, count(*) as total"""


@query(f"select c_mktsegment, c_nationkey, {_TALLY} from orders join customer on o_custkey = c_custkey group by 1, 2")
def vote_matrix_cells(t: Tables) -> DataFrame:
    return matrix.cells(_ballots(t), ["c_mktsegment", "c_nationkey"], F.col("o_orderstatus"), **SIGNS)


@query(f"""select c_mktsegment, c_nationkey, {_TALLY}, case when grouping(c_mktsegment) = 0 and grouping(c_nationkey) = 0 then 'cell'
when grouping(c_mktsegment) = 0 then 'group' when grouping(c_nationkey) = 0 then 'country' else 'vote' end as level
from orders join customer on o_custkey = c_custkey group by grouping sets ((c_mktsegment, c_nationkey), (c_mktsegment), (c_nationkey), ())""")
def vote_matrix_marginals(t: Tables) -> DataFrame:
    return matrix.marginals(_ballots(t), "c_mktsegment", "c_nationkey", F.col("o_orderstatus"), **SIGNS)


@query("""select o_orderpriority, o_orderstatus, grouping(o_orderpriority)::int as gp, grouping(o_orderstatus)::int as gs, count(*) as n
from orders group by cube (o_orderpriority, o_orderstatus)""")
def grouping_sets_matrix(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderpriority", "o_orderstatus").agg(
        F.grouping("o_orderpriority").cast("int").alias("gp"), F.grouping("o_orderstatus").cast("int").alias("gs"), F.count("*").alias("n")
    )


@query("""with c as (select c_mktsegment, c_nationkey, count(*) filter (o_orderstatus = 'F') - count(*) filter (o_orderstatus = 'O') as d
from orders join customer on o_custkey = c_custkey group by 1, 2),
s as (select *, max(d) over (partition by c_mktsegment) - min(d) over (partition by c_mktsegment) as span from c)
select c_mktsegment, c_nationkey, d, (case when span = 0 then null when d < 0 then floor(d * 10 / span::double) else ceil(d * 10 / span::double) end)::bigint as heat from s""")
def heatmap_class(t: Tables) -> DataFrame:
    cells = _ballots(t).groupBy("c_mktsegment", "c_nationkey").agg(*matrix.tally(F.col("o_orderstatus"), **SIGNS))
    rows = cells.select("c_mktsegment", "c_nationkey", (F.col("plus") - F.col("minus")).alias("d"))
    return matrix.heat(rows, F.col("d"), ["c_mktsegment"])


def _cohesion(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = rows.select("c_nationkey", month.alias("month"), "o_orderstatus", "o_custkey")
    return similarity.cohesion(rows, ["c_nationkey"], "month", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", "o_custkey")


_COHESION = """select c_nationkey, strftime(o_orderdate, '%Y-%m') as month,
(count(*) filter (o_orderstatus = 'F') - count(*) filter (o_orderstatus = 'O')) / count(distinct o_custkey)::double as t
from orders join customer on o_custkey = c_custkey group by 1, 2"""


@query(f"select c_nationkey, month, round(t, 6) as t from ({_COHESION})")
def group_cohesion(t: Tables) -> DataFrame:
    return _cohesion(t).withColumn("t", F.round("t", 6))


@query(f"""with v as ({_COHESION}) select a.c_nationkey as a, b.c_nationkey as b,
round(sum(a.t * b.t) / nullif(sqrt(sum(a.t * a.t) * sum(b.t * b.t)), 0), 6) as similarity, count(*) as n
from v a join v b on a.month = b.month and a.c_nationkey < b.c_nationkey group by 1, 2""")
def pairwise_cosine(t: Tables) -> DataFrame:
    return similarity.pairwise_cosine(_cohesion(t), "c_nationkey", "month", "t").withColumn("similarity", F.round("similarity", 6))


@query("""with k as (select unnest(json_keys(props)) as key, props from events)
select key, lower(case json_type(props, '$.' || key) when 'UBIGINT' then 'bigint' when 'VARCHAR' then 'string' else json_type(props, '$.' || key) end) as type,
count(*) as n, round(100.0 * count(*) / (select count(*) from events), 6) as percent from k group by 1, 2""")
def schema_profile(t: Tables) -> DataFrame:
    return profile.flat(t.events.select("props"), "props").withColumn("percent", F.round("percent", 6))


@query("""select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, count(*) filter (event_type = 'error' or value > 90) as errors from events group by 1, 2""")
def log_level_stats(t: Tables) -> DataFrame:
    return logs.level_stats(t.events, [F.date_format("ts", "yyyy-MM-dd").alias("day")], F.col("event_type"), (F.col("event_type") == "error") | (F.col("value") > 90))


@query("select props, count(*) as n from events group by props order by n desc, props limit 10")
def top_messages(t: Tables) -> DataFrame:
    return logs.top_messages(t.events, "props", 10)


@query("""select l_orderkey, arg_min(l_shipdate, (l_linenumber, l_partkey, l_extendedprice)) as l_shipdate, count(*) as n, min(l_partkey) as low, max(l_partkey) as high from lineitem group by l_orderkey""")
def nest_rows(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    rows = rollup.nested(lines, ["l_orderkey"], ["l_shipdate"], ["l_partkey"], "pos")
    parts = F.transform("items", lambda i: i.l_partkey)
    return rows.select("l_orderkey", "l_shipdate", F.size("items").cast("long").alias("n"), F.array_min(parts).alias("low"), F.array_max(parts).alias("high"))


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)""")
def rollup_two_level(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""select c_custkey, coalesce((select arg_min(o_orderkey::varchar, o_orderkey) from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT'), '') as first from customer""")
def first_match_attribute(t: Tables) -> DataFrame:
    lists = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("items"))
    rows = t.customer.select("c_custkey").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    first = lookup.first_match(F.col("items"), lambda i: i.o_orderpriority == "1-URGENT", lambda i: i.o_orderkey.cast("string"), "")
    return rows.select("c_custkey", first.alias("first"))


@query("""select p_type, count(*) as n, string_agg(p_name, ',' order by p_name) as names from (select distinct p_type, p_name from part where p_size > 40) group by p_type""")
def grouped_names(t: Tables) -> DataFrame:
    rows = t.part.where("p_size > 40").select("p_type", "p_name").distinct()
    return rows.groupBy("p_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p_name")), ",").alias("names"))


@query("""select o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1, 2""")
def dedupe_last_wins(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")
    return index.last_wins(rows, ["o_custkey", "o_orderpriority"], ["o_orderkey"]).drop("o_orderkey")
