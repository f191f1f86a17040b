"""Scalar functions on the driver's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import dates, text
from quaestor.plans.registry import Tables, query


@query("""select o_orderkey, o_orderdate::date as d from orders""")
def multi_format_date(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    d = F.col("o_orderdate")
    written = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "dd-MM-yyyy"))
    return t.orders.select("o_orderkey", dates.as_date(written).alias("d"))


@query("""select term, count(*) as n from (select case when d between date '1989-07-25' and date '1994-07-18' then 3 when d between date '1994-07-19' and date '1999-07-19' then 4
when d between date '1999-07-20' and date '2004-07-19' then 5 end as term from (select o_orderdate::date as d from orders)) group by term""")
def term_bucket_range_join(t: Tables) -> DataFrame:
    return t.orders.groupBy(dates.term(F.col("o_orderdate")).alias("term")).agg(F.count("*").alias("n"))


@query("""select p_partkey, regexp_replace(regexp_replace(p_type, '^STANDARD ', 'STD '), '^STD ANODIZED', 'SA') as p_type from part""")
def prefix_rewrite(t: Tables) -> DataFrame:
    rules = (("^STANDARD ", "STD "), ("^STD ANODIZED", "SA"))
    return t.part.select("p_partkey", text.rewritten(F.array("p_type"), rules)[0].alias("p_type"))


@query(r"""select c_custkey, ref from (select c_custkey, unnest(regexp_extract_all('see ' || c_name || ' 2019/' || lpad((c_custkey % 10000)::varchar, 4, '0') || '(COD) and 2020/' || lpad((c_custkey % 9999)::varchar, 4, '0') || 'B(INI)',
'[0-9]{4}/[0-9]{4}[A-Z]?\([A-Z*]{3}\)')) as ref from customer)""")
def regex_extract_ids(t: Tables) -> DataFrame:
    def padded(n: int) -> Column:
        return F.lpad((F.col("c_custkey") % n).cast("string"), 4, "0")

    line = F.concat(F.lit("see "), "c_name", F.lit(" 2019/"), padded(10000), F.lit("(COD) and 2020/"), padded(9999), F.lit("B(INI)"))
    return t.customer.select("c_custkey", F.explode(text.dossier_ids(line)).alias("ref"))


@query("""select c_custkey, substr(ref, length(ref) - 3, 3) || '/' || substr(ref, 1, 9) as path from (select c_custkey, '2019/' || lpad((c_custkey % 10000)::varchar, 4, '0') || '(COD)' as ref from customer)""")
def slice_concat(t: Tables) -> DataFrame:
    ref = F.concat(F.lit("2019/"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("(COD)"))
    return t.customer.select("c_custkey", text.slice_path(ref).alias("path"))


@query("""select doc_id, printf('%.1f', n / pow(1024, k)) || ' ' || (['bytes', 'KiB', 'MiB'])[k + 1] as size from
(select doc_id, n_chars * 37 as n, case when n_chars > 0 then floor(log2(n_chars * 37) / 10) else 0 end::int as k from documents)""")
def human_size(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.human_size(F.col("n_chars") * 37).alias("size"))


@query(r"""select doc_id, length(trim(regexp_replace(text, '[\s\x{1c}-\x{1f}]+', ' ', 'g'))) as n from documents""")
def collapse_whitespace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(text.collapse(F.col("text"))).cast("long").alias("n"))


@query("""select p_partkey, lower(regexp_replace(p_name || ' ' || p_brand, '[^0-9A-Za-z]', '', 'g')) as name from part""")
def normalize_alnum(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.normalize_ascii(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))


@query("""select c_custkey, name from (select c_custkey, unnest([c_name, c_mktsegment, 'X' || c_custkey::varchar]) as name from customer)""")
def multi_delimiter_split(t: Tables) -> DataFrame:
    line = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(" and X"), F.col("c_custkey").cast("string"), F.lit(" on behalf of the Y Group"))
    return t.customer.select("c_custkey", F.explode(text.split_names(line)).alias("name"))


@query("""select s_suppkey, reverse(replace(replace('moc[dot]elpmaxe[at]' || s_name, '[at]', '@'), '[dot]', '.')) as mail from supplier""")
def string_reverse_replace(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text.deobfuscated(F.concat(F.lit("mailto:moc[dot]elpmaxe[at]"), "s_name")).alias("mail"))


@query("""select n_nationkey, (ascii(lower(n_name[1])) - 96) * 26 + ascii(lower(n_name[2])) - 96 as ordinal from nation""")
def base26_ordinal(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.base26(F.left("n_name", F.lit(2))).alias("ordinal"))


@query("""select p_partkey, generate_subscripts(a, 1)::int as pos, unnest(a) as word, unnest(b) as other from (select p_partkey, string_split(p_name, ' ') as a,
list_resize(string_split(p_type, ' '), greatest(len(string_split(p_type, ' ')), len(string_split(p_name, ' ')))) as b from part) where len(a) >= len(b)""")
def arrays_zip_pairs(t: Tables) -> DataFrame:
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    rows = t.part.where(F.size(a) >= F.size(b)).select("p_partkey", F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("pos", "z"))
    return rows.select("p_partkey", (F.col("pos") + 1).alias("pos"), F.col("z.a").alias("word"), F.col("z.b").alias("other"))


@query("""select distinct c_mktsegment, 'img/' || replace(lower(c_mktsegment), '/', '_') || '.gif' as path from customer""")
def slug_path(t: Tables) -> DataFrame:
    return t.customer.select("c_mktsegment", text.slug(F.col("c_mktsegment"), "img/", ".gif").alias("path")).distinct()


@query("""select p_partkey, p_brand || ' - ' || p_name as head, p_type as last from part""")
def split_last_part(t: Tables) -> DataFrame:
    found = text.split_last(F.concat_ws(" - ", "p_brand", "p_name", "p_type"))
    return t.part.select("p_partkey", found.alias("x")).select("p_partkey", "x.head", "x.last")


@query("""select c_custkey, c_name as party, n_name as country from customer join nation on n_nationkey = c_nationkey""")
def party_country_split(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = text.party_country(F.concat("c_name", F.lit(" ("), "n_name", F.lit(")")))
    return rows.select("c_custkey", found.alias("x")).select("c_custkey", "x.party", "x.country")


@query("""select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as shown, strftime(o_orderdate, '%Y-%m-%dT00:00:00') as iso from orders""")
def date_display(t: Tables) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return t.orders.select("o_orderkey", dates.shown(d).alias("shown"), dates.iso(d).alias("iso"))
