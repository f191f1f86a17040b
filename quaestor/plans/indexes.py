"""Lookups and inverted indexes on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import index, lookup, search
from quaestor.plans.registry import Tables, query

WANTED = (5, 1, 999999999, 17, 5, 42)


@query("""select 'region' as name, count(*) as n from region union all select 'nation', count(*) from nation
union all select 'customer', count(*) from customer union all select 'supplier', count(*) from supplier
union all select 'part', count(*) from part union all select 'orders', count(*) from orders
union all select 'lineitem', count(*) from lineitem union all select 'events', count(*) from events""")
def table_counts(t: Tables) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    out = None
    for n in names:
        one = getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select p_partkey, p_name, p_size from part where p_partkey = 17")
def point_get(t: Tables) -> DataFrame:
    return t.part.where("p_partkey = 17").select("p_partkey", "p_name", "p_size")


@query("""select w.pos, w.wanted, p.p_name, p.p_brand from (values (0, 5), (1, 1), (2, 999999999), (3, 17), (4, 5), (5, 42)) w(pos, wanted)
left join part p on p.p_partkey = w.wanted""")
def multi_get(t: Tables) -> DataFrame:
    return lookup.multi_get(t.part.select("p_partkey", "p_name", "p_brand"), "p_partkey", WANTED).select("pos", "wanted", "p_name", "p_brand")


@query("""select c_nationkey, count(*) as n from customer join orders on c_custkey = o_custkey group by c_nationkey""")
def index_key_counts(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey")
    return index.key_counts(t.orders.select("o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")), "c_nationkey")


@query("""select k, count(*) as n, min(p_partkey) as first from (select distinct p_partkey, unnest(string_split(p_type, ' ')) as k from part) group by k""")
def inverted_index_distinct(t: Tables) -> DataFrame:
    rows = index.inverted_index(t.part.select("p_partkey", "p_type"), F.split("p_type", " "))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("""select k, count(*) as n, count(distinct p_partkey) as parts from (select p_partkey, unnest(string_split(p_name, ' ')) as k from part) group by k""")
def inverted_index_multi(t: Tables) -> DataFrame:
    rows = index.inverted_index(t.part.select("p_partkey", "p_name"), F.split("p_name", " "), distinct=False)
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"))


@query("""select nullif(o_orderpriority, '5-LOW') as k, count(*) as n from orders group by 1""")
def index_keep_null_key(t: Tables) -> DataFrame:
    key = F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))
    return index.key_counts(index.inverted_index(t.orders.select("o_orderkey", "o_orderpriority"), key, keep_null=True), "k")


@query("""select nullif(o_orderpriority, '5-LOW') as k, count(*) as n from orders where nullif(o_orderpriority, '5-LOW') is not null group by 1""")
def index_skip_null_key(t: Tables) -> DataFrame:
    key = F.array(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return index.key_counts(index.inverted_index(t.orders.select("o_orderkey", "o_orderpriority"), key), "k")


@query("""select p_brand, arg_max(p_name, p_partkey) as p_name from part group by p_brand""")
def index_last_wins_map(t: Tables) -> DataFrame:
    return index.last_wins(t.part.select("p_brand", "p_name", "p_partkey"), ["p_brand"], ["p_partkey"]).select("p_brand", "p_name")


@query("""select k, count(*) as n, min(doc) as first, max(doc) as last from (
select l_suppkey as k, l_partkey as doc from lineitem where l_returnflag = 'R'
union select l_suppkey, l_partkey from lineitem where l_linestatus = 'O') group by k""")
def index_union_distinct(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("doc"), "l_returnflag", "l_linestatus")
    both = index.union_distinct(rows.where("l_returnflag = 'R'").select("k", "doc"), rows.where("l_linestatus = 'O'").select("k", "doc"))
    return both.groupBy("k").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))


@query("""select o_orderpriority || o_orderstatus as k, count(*) as n from orders where o_totalprice > 150000 group by 1""")
def index_composite_key_filtered(t: Tables) -> DataFrame:
    return index.key_counts(t.orders.where("o_totalprice > 150000").select(F.concat("o_orderpriority", "o_orderstatus").alias("k")), "k")


@query("""select k, string_agg(doc::varchar, ',' order by doc) as docs from (select distinct o_custkey as k, o_orderkey as doc from orders) group by k""")
def index_postings(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("doc"))
    return index.postings(rows, F.col("doc"), F.col("doc")).select("k", F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"))


@query("""select case when o_orderstatus in ('F') then 'inactive' else 'active' end as bucket, count(*) as n, min(o_orderkey) as first
from orders where o_orderstatus is not null group by 1""")
def partition_by_status(t: Tables) -> DataFrame:
    bucket = F.when(F.col("o_orderstatus").isin("F"), "inactive").otherwise("active")
    rows = t.orders.where("o_orderstatus is not null").select(bucket.alias("bucket"), "o_orderkey")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""select doc_id from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
where contains(lower(line), 'the') and contains(lower(line), 'and') group by doc_id""")
def search_and_terms(t: Tables) -> DataFrame:
    return t.documents.where(search.has_terms(F.col("text"), "THE and")).select("doc_id")


@query("""with exact as (select p_partkey, p_name from part where lower(p_name) = 'no such part'),
loose as (select p_partkey, p_name from part where contains(lower(p_name), 'red') and contains(lower(p_name), 'i') and not exists (select 1 from exact))
select * from exact union all select * from loose""")
def search_fallback(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_name")
    return search.exact_or_pattern(p, search.normal_name(F.col("p_name")) == "nosuchpart", search.has_terms(F.col("p_name"), "I red"))


CHOSEN = {"p_brand": ["Brand#1", "Brand#2", "Brand#3"], "p_size": [1, 2, 3, 4, 5, 10, 20, 30]}


@query("""select 'p_brand' as facet, p_brand as value, count(*) as n from part where p_size in (1,2,3,4,5,10,20,30) group by p_brand
union all select 'p_size', p_size::varchar, count(*) from part where p_brand in ('Brand#1','Brand#2','Brand#3') group by p_size
union all select 'p_type', p_type, count(*) from part where p_brand in ('Brand#1','Brand#2','Brand#3') and p_size in (1,2,3,4,5,10,20,30) group by p_type""")
def faceted_filter(t: Tables) -> DataFrame:
    return search.facet_values(t.part, ["p_brand", "p_size", "p_type"], CHOSEN)
