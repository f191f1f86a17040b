"""Joins: lookups, intervals, resolution, co-occurrence, positions, rules, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators import interval, lookup, resolve, rollup, similarity
from quaestor.plans.registry import Tables, query


@query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey")
def dim_lookup(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name")
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


_SPANS = """spans as (select o_custkey as k, o_orderkey as id, o_orderdate as s,
coalesce(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), timestamp '9999-12-31') as e,
row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders)"""


def _spans(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("s"),
        F.coalesce(F.lead("o_orderdate").over(w), F.to_timestamp(F.lit("9999-12-31"))).alias("e"), F.row_number().over(w).alias("pos"),
    )


@query(f"""with {_SPANS}, probes as (select o_orderkey as row, o_custkey as k, o_orderdate + interval 30 day as at from orders)
select p.row, arg_min(s.id, s.pos) as id from probes p left join spans s on s.k = p.k and s.s <= p.at and p.at <= s.e group by p.row""")
def interval_join_first(t: Tables) -> DataFrame:
    probes = t.orders.select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("at"))
    return interval.interval_join(probes, _spans(t), "k", "at", "s", "e", "pos").select("row", F.col("match.id").alias("id"))


@query(f"""with {_SPANS}, probes as (select o_orderkey as row, o_custkey as k, o_orderdate - interval 30 day as at from orders)
select p.row, arg_min(s.id, s.pos) as id from probes p join spans s on s.k = p.k and s.s <= p.at and p.at <= s.e group by p.row""")
def interval_join_inner(t: Tables) -> DataFrame:
    probes = t.orders.select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("k"), (F.col("o_orderdate") - F.expr("interval 30 days")).alias("at"))
    return interval.interval_join(probes, _spans(t), "k", "at", "s", "e", "pos", "inner").select("row", F.col("match.id").alias("id"))


@query(f"""with {_SPANS} select k, arg_min(id, pos) as id from spans where s <= timestamp '1996-01-01' and timestamp '1996-01-01' <= e group by k""")
def interval_array_first(t: Tables) -> DataFrame:
    lists = _spans(t).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "s", "e"))).alias("items"))
    found = lists.select("k", interval.first_valid(F.col("items"), F.to_timestamp(F.lit("1996-01-01")), "s", "e").alias("m"))
    return found.where("m is not null").select("k", F.col("m.id").alias("id"))


@query("""with s as (select o_custkey as k, o_orderkey as id, o_orderstatus as v, greatest(o_orderdate::date, date '1996-01-01') as a,
least((o_orderdate + interval 20 day)::date, date '1996-12-31') as z from orders),
d as (select k, id, v, unnest(generate_series(a, z, interval 1 day))::date as day from s where a <= z)
select k, day, arg_max(v, id) as v from d group by k, day""")
def interval_day_expand(t: Tables) -> DataFrame:
    spans = t.orders.select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"), F.col("o_orderdate").alias("s"),
        (F.col("o_orderdate") + F.expr("interval 20 days")).alias("e"),
    )
    return interval.expand_days(spans, "k", "s", "e", "v", "id", "1996-01-01", "1996-12-31")


@query("""select o_orderkey from orders where (o_orderdate + interval 60 day) is null or (o_orderdate <= timestamp '1997-06-01' and timestamp '1997-06-01' <= o_orderdate + interval 60 day)""")
def valid_at_filter(t: Tables) -> DataFrame:
    at = F.to_timestamp(F.lit("1997-06-01"))
    return t.orders.where(interval.valid_at(at, F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 60 days"))).select("o_orderkey")


@query("""with u as (select c_nationkey as key, c_custkey as person, 'Customer' as role from customer
union all select s_nationkey, s_suppkey, 'Supplier' from supplier
union all select c_nationkey, o_custkey, case when o_orderstatus = 'P' then 'Pending' when o_orderstatus = 'O' then 'Open' end from orders join customer on o_custkey = c_custkey)
select role, key, count(*) as n, count(distinct person) as people from u
where role is not null and key in (select n_nationkey from nation where n_regionkey < 3) group by role, key""")
def role_union_semijoin(t: Tables) -> DataFrame:
    orders = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "P", "Pending").when(F.col("o_orderstatus") == "O", "Open")
    rows = lookup.union_roles(
        (t.customer, "c_nationkey", "c_custkey", F.lit("Customer")), (t.supplier, "s_nationkey", "s_suppkey", F.lit("Supplier")), (orders, "c_nationkey", "o_custkey", status)
    )
    known = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("key"))
    return rows.join(known, "key", "left_semi").groupBy("role", "key").agg(F.count("*").alias("n"), F.count_distinct("person").alias("people"))


@query("""with c as (select o_orderkey as probe, x.c_custkey as entity, x.c_acctbal > 0 as v, x.c_custkey % 3 = o_orderkey % 3 as g, x.c_custkey % 5 = o_orderkey % 5 as l, o_orderstatus <> 'P' as d
from orders join customer y on o_custkey = y.c_custkey join customer x on x.c_nationkey = y.c_nationkey and x.c_mktsegment = y.c_mktsegment and right(x.c_name, 2) = right(y.c_name, 2)),
n as (select probe, count(*) as n, count(*) filter (v) as nv, count(*) filter (v and g) as ng, count(*) filter (v and l) as nl, bool_or(d) as d,
min(entity) as e, min(entity) filter (v) as ev, min(entity) filter (v and g) as eg, min(entity) filter (v and l) as el from c group by probe)
select probe, case when n = 1 then e when not d then null when nv = 0 then null when nv = 1 then ev when ng = 1 then eg when nl = 1 then el end as entity from n""")
def entity_resolution_cascade(t: Tables) -> DataFrame:
    name = F.right("c_name", F.lit(2)).alias("name")  # what candidates share: nation, segment and the end of the name
    x = t.customer.select(F.col("c_custkey").alias("entity"), "c_nationkey", "c_mktsegment", name, "c_acctbal")
    y = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", name)
    probes = t.orders.join(y, F.col("o_custkey") == F.col("c_custkey"))
    c = probes.join(x, ["c_nationkey", "c_mktsegment", "name"]).withColumnRenamed("o_orderkey", "probe")
    return resolve.resolve(c, "probe", "entity", F.col("c_acctbal") > 0, F.expr("entity % 3 = probe % 3"), F.expr("entity % 5 = probe % 5"), F.expr("o_orderstatus <> 'P'"))


@query("""select b.l_partkey as item, count(*) as n from lineitem b where b.l_partkey <> 17 and b.l_orderkey in (select l_orderkey from lineitem where l_partkey = 17) group by 1""")
def cooccurrence_for_key(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("item"))
    return similarity.cooccurrence_for(rows, "l_orderkey", "item", 17)


@query("""with r as (select distinct l_orderkey, l_suppkey from lineitem) select a.l_suppkey as a, b.l_suppkey as b, count(*) as n
from r a join r b using (l_orderkey) where a.l_suppkey < b.l_suppkey group by 1, 2""")
def cooccurrence_pairs(t: Tables) -> DataFrame:
    return similarity.cooccurrence(t.lineitem, "l_orderkey", "l_suppkey")


@query("""select o_orderkey, count(l.l_orderkey) as n, min(l_suppkey) as low, max(l_suppkey) as high from orders
left join lineitem l on l_orderkey = o_orderkey and l_shipdate >= o_orderdate and l_returnflag <> 'N' group by o_orderkey""")
def nested_enrichment(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_returnflag <> 'N'").select("l_orderkey", "l_suppkey", "l_shipdate")
    hits = t.orders.select("o_orderkey", "o_orderdate").join(rows, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    item = F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_suppkey"))
    return hits.groupBy("o_orderkey").agg(F.count(item).alias("n"), F.min(item).alias("low"), F.max(item).alias("high"))


@query("""with a as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as pos, l_partkey as pa from lineitem where l_returnflag = 'A'),
b as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as pos, l_partkey as pb from lineitem where l_returnflag = 'R')
select l_orderkey, pos, pa, pb from a full outer join b using (l_orderkey, pos)""")
def positional_full_outer(t: Tables) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    a = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", at.alias("pos"), F.col("l_partkey").alias("pa"))
    b = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", at.alias("pos"), F.col("l_partkey").alias("pb"))
    return rollup.zipped(a, b, ["l_orderkey"])


@query("""with v as (select c_custkey, unnest(regexp_extract_all(c_name, '[0-9]+')) as seq from customer)
select v.c_custkey, s.s_suppkey, s.s_name from v join supplier s on s.s_suppkey = try_cast(v.seq as bigint)""")
def regex_list_join(t: Tables) -> DataFrame:
    v = t.customer.select("c_custkey", F.explode(F.regexp_extract_all("c_name", F.lit("[0-9]+"), F.lit(0))).alias("seq"))
    s = t.supplier.select("s_suppkey", "s_name")
    return v.join(s, F.col("s_suppkey") == F.col("seq").try_cast("long")).select("c_custkey", "s_suppkey", "s_name")


@query("""select o_orderkey, coalesce(s.s_name, p.p_name, c.c_name) as found from orders
left join supplier s on s.s_suppkey = o_orderkey left join part p on p.p_partkey = o_orderkey left join customer c on c.c_custkey = o_custkey""")
def priority_lookup(t: Tables) -> DataFrame:
    o, s, p, c = t.orders.select("o_orderkey", "o_custkey"), t.supplier.select("s_suppkey", "s_name"), t.part.select("p_partkey", "p_name"), t.customer.select("c_custkey", "c_name")
    stages = [(s, F.col("s_suppkey") == F.col("o_orderkey"), "s_name"), (p, F.col("p_partkey") == F.col("o_orderkey"), "p_name"), (c, F.col("c_custkey") == F.col("o_custkey"), "c_name")]
    return lookup.priority_lookup(o, stages, "found").select("o_orderkey", "found")


@query("""select category, count(*) as n from (select case when p_type like 'STANDARD%' then 'standard' when p_type like 'S%' then 'small'
when p_type like 'PROMO%' then 'promo' when p_type like 'E%' then 'economy' else 'other' end as category from part) group by category""")
def prefix_rule_join(t: Tables) -> DataFrame:
    rules = [("STANDARD", "standard"), ("S", "small"), ("PROMO", "promo"), ("E", "economy")]
    return t.part.select(lookup.prefix_rules(F.col("p_type"), rules, "other").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_join_known(t: Tables) -> DataFrame:
    known = t.orders.where("o_orderstatus = 'P'").select("o_custkey")
    return t.customer.select("c_custkey", "c_name").join(known, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("select l_partkey as k from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R'")
def set_intersect(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("k"), "l_returnflag")
    return rows.where("l_returnflag = 'A'").select("k").intersect(rows.where("l_returnflag = 'R'").select("k"))


@query("select c_custkey as k from customer except select s_suppkey from supplier")
def set_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.supplier.select("s_suppkey"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""select o_custkey, min(o_orderkey) as first from orders group by o_custkey""")
def distinct_keep_order(t: Tables) -> DataFrame:
    from quaestor.operators.index import first_wins

    return first_wins(t.orders.select("o_custkey", F.col("o_orderkey").alias("first")), ["o_custkey"], ["first"])


@query("""select r_name, n_name, count(c_custkey) as n from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by r_name, n_name""")
def relational_fk_join(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))  # counted before the join
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n"))
