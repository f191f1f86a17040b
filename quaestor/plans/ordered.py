"""Windows, order-dependent operators, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import ordered, rollup
from quaestor.plans.registry import Tables, query


@query("""select o_custkey, arg_max(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) as o_orderkey, max(o_orderdate) as o_orderdate from orders group by o_custkey""")
def latest_per_key(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


@query("""with l as (select o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as o_orderkey from orders group by 1, 2),
s as (select o_orderpriority, o_custkey, status = 'O' as is_current, case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 else 1 end as score, c_name
from l join customer on c_custkey = o_custkey)
select * from (select o_orderpriority, c_name, score, is_current, row_number() over (partition by o_orderpriority order by is_current desc, score desc, c_name desc) as place from s) where place <= 20""")
def committee_roster_rank(t: Tables) -> DataFrame:
    last = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    score = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 4).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(1)
    rows = last.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderpriority", "c_name", score.alias("score"), (F.col("status") == "O").alias("is_current"))
    return ordered.top_k(rows, ["o_orderpriority"], [F.desc("is_current"), F.desc("score"), F.desc("c_name")], 20, "place")


@query("""select o_custkey, round(-1 + sum(case when o_orderstatus = 'O' then case o_orderpriority when '1-URGENT' then 3.5 when '2-HIGH' then 2.25 when '3-MEDIUM' then 1.5 else 0.5 end else 0 end)::double, 4) as score
from orders group by o_custkey""")
def weighted_role_rank(t: Tables) -> DataFrame:
    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 3.5).when(F.col("o_orderpriority") == "2-HIGH", 2.25).when(F.col("o_orderpriority") == "3-MEDIUM", 1.5).otherwise(0.5)
    return ordered.weighted_rank(t.orders, ["o_custkey"], F.col("o_orderstatus") == "O", weight).withColumn("score", F.round("score", 4))


@query("""select event_id, coalesce(last_value(case event_type when 'signup' then 1 when 'error' then 0 end ignore nulls)
over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 0)::int as state from events""")
def toggle_state_ffill(t: Tables) -> DataFrame:
    marker = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 0)
    return ordered.toggle(t.events, ["user_id"], ["ts", "event_id"], marker).select("event_id", "state")


@query("""select event_id, errors, errors > 10 as tripped from (select event_id, (sum(case when event_type = 'error' then 1 else 0 end)
over (partition by user_id order by ts, event_id rows between 49 preceding and current row))::bigint as errors from events)""")
def sliding_error_rate(t: Tables) -> DataFrame:
    return ordered.sliding_errors(t.events, ["user_id"], ["ts", "event_id"], (F.col("event_type") == "error").cast("int")).select("event_id", "errors", "tripped")


@query("""select key, kind, ref, ts from (select o_custkey as key, 'placed' as kind, o_orderkey as ref, o_orderdate as ts from orders
union all select o_custkey, 'shipped', l_orderkey, l_shipdate from lineitem join orders on o_orderkey = l_orderkey
union all select user_id, event_type, event_id, ts from events) where ts is not null""")
def event_timeline_union(t: Tables) -> DataFrame:
    o = t.orders
    shipped = t.lineitem.select("l_orderkey", "l_shipdate").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rollup.timeline(
        (o, F.col("o_custkey"), F.lit("placed"), F.col("o_orderkey"), F.col("o_orderdate")),
        (shipped, F.col("o_custkey"), F.lit("shipped"), F.col("l_orderkey"), F.col("l_shipdate")),
        (t.events, F.col("user_id"), F.col("event_type"), F.col("event_id"), F.col("ts")),
    )


@query("""with m as (select user_id, event_id, ts, case event_type when 'signup' then 10 when 'view' then 20 when 'click' then 40 when 'purchase' then 100 end as pct, case when value > 50 then 30 else 0 end as low from events),
l as (select user_id, pct from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from m where pct is not null) where r = 1)
select user_id, greatest(coalesce(l.pct, 0), coalesce(max(low), 0))::int as progress from m left join l using (user_id) group by user_id, l.pct""")
def stage_progress(t: Tables) -> DataFrame:
    e = F.col("event_type")
    percent = F.when(e == "signup", 10).when(e == "view", 20).when(e == "click", 40).when(e == "purchase", 100)
    return ordered.progress(t.events, ["user_id"], percent, ["ts", "event_id"], F.when(F.col("value") > 50, 30).otherwise(0))


@query("""select * from (select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 3""")
def topk_per_group(t: Tables) -> DataFrame:
    return ordered.top_k(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


_ISLANDS = """select o_custkey, min(d) as first, max(d) as last, count(*) as size from (select o_custkey, d, d - row_number() over (partition by o_custkey order by d) as i
from (select distinct o_custkey, date_diff('month', date '1990-01-01', o_orderdate::date) as d from orders)) group by o_custkey, i"""


def _months(t: Tables) -> DataFrame:
    month = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1
    return t.orders.select("o_custkey", month.cast("long").alias("d"))


@query(_ISLANDS)
def gaps_and_islands(t: Tables) -> DataFrame:
    return ordered.islands(_months(t), ["o_custkey"], "d")


@query(f"""select o_custkey, string_agg(case when first = last then first::varchar else first::varchar || '-' || last::varchar end, ',' order by first) as ranges from ({_ISLANDS}) group by o_custkey""")
def range_compression(t: Tables) -> DataFrame:
    return ordered.ranges(_months(t), ["o_custkey"], "d")


@query("""select user_id, segment, count(*) as n, min(event_id) as first from (select user_id, event_id, (sum(case when event_type = 'signup' then 1 else 0 end)
over (partition by user_id order by ts, event_id rows between unbounded preceding and current row))::bigint as segment from events) group by 1, 2""")
def segment_by_marker(t: Tables) -> DataFrame:
    rows = ordered.segments(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""select l_orderkey, header, count(*) as n, round(sum(l_quantity), 2) as quantity from (select l_orderkey, l_quantity,
last_value(case when l_linenumber % 3 = 1 then l_shipdate end ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice rows between unbounded preceding and current row) as header from lineitem) group by 1, 2""")
def forward_fill_group(t: Tables) -> DataFrame:
    rows = ordered.forward_fill(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], F.when(F.col("l_linenumber") % 3 == 1, F.col("l_shipdate")), "header")
    return rows.groupBy("l_orderkey", "header").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""select p_partkey, seq, k, row_number() over (order by p_brand desc, k, p_partkey) as place from
(select p_partkey, p_brand, case when p_size % 4 = 0 then chr(65 + p_size) else p_size::varchar end as seq, coalesce(try_cast(case when p_size % 4 = 0 then chr(65 + p_size) else p_size::varchar end as bigint), ascii(chr(65 + p_size)))::bigint as k from part)""")
def mixed_key_sort(t: Tables) -> DataFrame:
    seq = F.when(F.col("p_size") % 4 == 0, F.chr(F.col("p_size") + 65)).otherwise(F.col("p_size").cast("string"))
    rows = t.part.select("p_partkey", "p_brand", seq.alias("seq")).withColumn("k", ordered.mixed_key(F.col("seq")))
    ranked = ordered.global_rank(rows, [F.desc("p_brand"), F.asc("k"), F.asc("p_partkey")])
    return ranked.select("p_partkey", "seq", "k", "place")


@query("""select line, docs from (select line, count(distinct doc_id) as docs from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> '' group by line) where docs >= 5""")
def repeated_lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "")
    return rows.groupBy("line").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 5")


@query("select label, n from (select distinct c_mktsegment as label, lower(c_mktsegment) as k, count(*) over (partition by c_mktsegment) as n from customer)")
def label_list(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n")).orderBy(F.lower("label"))


@query("""select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1998-01-01' order by o_orderdate, o_orderkey""")
def upcoming_sorted(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate >= timestamp'1998-01-01'").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")
