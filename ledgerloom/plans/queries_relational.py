"""Plain relational work on the raw tables: scans, joins, sets, windows, top-k, JSON, arrays, text."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..operators import search
from .catalog import register
from .oracle import with_views


@register("r_scan_filter_project", "select l_orderkey, l_partkey, round(l_extendedprice * 100)::bigint as price from lineitem where l_shipdate >= timestamp '1998-01-01' and l_shipdate < timestamp '1998-02-01' and l_quantity > 40")
def scan(b):
    rows = b.read("lineitem").filter("l_shipdate >= timestamp '1998-01-01' and l_shipdate < timestamp '1998-02-01' and l_quantity > 40")
    return rows.select("l_orderkey", "l_partkey", cents("l_extendedprice").alias("price"))


@register("r_group_sum_count", "select l_returnflag, l_linestatus, sum(round(l_extendedprice * 100)::bigint)::bigint as price, sum(l_quantity)::bigint as quantity, count(*) as n from lineitem group by all")
def group(b):
    return b.read("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(cents("l_extendedprice")).alias("price"), F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n"))


@register("r_filtered_counts", "select o_orderstatus, count(*) filter (o_orderpriority = '1-URGENT') as n_urgent, count(*) filter (o_totalprice > 250000) as n_large, count(*) as n from orders group by 1")
def filtered(b):
    return b.read("orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"), F.count_if(F.col("o_totalprice") > 250000).alias("n_large"), F.count("*").alias("n"))


@register("r_left_join_zero_filled", "select c_custkey, coalesce(count(o_orderkey), 0) as n, coalesce(sum(round(o_totalprice * 100)::bigint), 0)::bigint as total from customer left join orders on o_custkey = c_custkey group by 1")
def left(b):
    sums = b.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total"))
    return b.read("customer").select("c_custkey").join(sums, "c_custkey", "left").fillna(0)


@register("r_semi_join", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def semi(b):
    return b.read("customer").select("c_custkey", "c_name").join(b.read("orders").filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@register("r_anti_join", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti(b):
    return b.read("orders").select("o_orderkey").join(b.read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@register("r_union_distinct_months", "select year(o_orderdate)::int as y, month(o_orderdate)::int as m from orders union select year(l_shipdate)::int, month(l_shipdate)::int from lineitem")
def months(b):
    of = lambda t, c: b.read(t).select(F.year(c).alias("y"), F.month(c).alias("m")).distinct()
    return of("orders", "o_orderdate").union(of("lineitem", "l_shipdate")).distinct()


@register("r_first_per_key", "select o_custkey, o_orderkey, o_orderdate::date as day from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def first(b):
    got = b.read("orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return got.select("o_custkey", "x.o_orderkey", F.to_date("x.o_orderdate").alias("day"))


@register("r_top_k", "select o_orderkey, round(o_totalprice * 100)::bigint as total from orders order by o_totalprice desc, o_orderkey limit 25")
def top(b):
    return b.read("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", cents("o_totalprice").alias("total"))


@register("r_top_k_per_group", "select l_suppkey, l_partkey, q::bigint as q, r::int as r from (select l_suppkey, l_partkey, q, row_number() over (partition by l_suppkey order by q desc, l_partkey) as r from (select l_suppkey, l_partkey, sum(l_quantity) as q from lineitem group by all)) where r <= 3")
def top_group(b):
    sums = b.read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return sums.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey"))).filter("r <= 3")


@register("r_json_field", "select event_type, count(*) as n, sum(json_extract_string(props, '$.k')::int)::bigint as k from events where json_extract_string(props, '$.k')::int > 20 group by 1")
def json(b):
    rows = b.read("events").withColumn("p", F.from_json("props", "struct<k:int>")).filter("p.k > 20")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@register("r_unnest_coalesce", "select w, count(*) as n from (select unnest(string_split(coalesce(p_name, 'none'), ' ')) as w from part) group by 1")
def unnest(b):
    return b.read("part").select(F.explode(F.split(F.coalesce("p_name", F.lit("none")), " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@register("r_pivot", "select o_custkey % 10 as k, coalesce(sum(round(o_totalprice * 100)::bigint) filter (o_orderstatus = 'F'), 0)::bigint as f, coalesce(sum(round(o_totalprice * 100)::bigint) filter (o_orderstatus = 'O'), 0)::bigint as o from orders group by 1")
def pivot(b):
    rows = b.read("orders").select((F.col("o_custkey") % 10).alias("k"), "o_orderstatus", cents("o_totalprice").alias("t"))
    got = rows.groupBy("k").pivot("o_orderstatus", ["F", "O"]).agg(F.sum("t")).fillna(0)
    return got.select("k", F.col("F").alias("f"), F.col("O").alias("o"))


@register("r_contains_all_words", "select p_partkey, p_name from part where p_name ilike '%red%' and p_name ilike '%ring%'")
def contains(b):
    return search.contains_all(b.read("part").select("p_partkey", "p_name"), "p_name", ["red", "ring"])


@register("r_full_text", r"select doc_id, true as every from documents where len(list_intersect(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ['pathetic', 'and'])) = 2")
def full_text(b):
    return search.full_text(b.read("documents"), "pathetic and")


@register("r_array_lengths", "select vec_id, len(embedding)::int as n, label from embeddings")
def arrays(b):
    return b.read("embeddings").select("vec_id", F.size("embedding").alias("n"), "label")


@register("r_upsert", "select coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v from (select c_custkey as k, round(c_acctbal * 100)::bigint as v from customer where c_custkey % 2 = 0) a full join (select c_custkey as k, 1::bigint as v from customer where c_custkey % 3 = 0) b on a.k = b.k")
def upsert(b):
    c = b.read("customer")
    old, new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), cents("c_acctbal").alias("v")), c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit(1).cast("long").alias("w"))
    return old.join(new, "k", "full_outer").select("k", F.coalesce("w", "v").alias("v"))


@register("r_hourly_events", "select date_trunc('hour', ts) as h, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from events group by all")
def hourly(b):
    return b.read("events").groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.count("*").alias("n"), F.sum(cents("value")).alias("cents"))


@register("r_sessions", "select user_id, count(*) filter (new) as n_sessions, count(*) as n from (select user_id, lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute as new from events window w as (partition by user_id order by ts, event_id)) group by 1")
def sessions(b):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes")
    return b.read("events").withColumn("new", F.coalesce(gap, F.lit(True))).groupBy("user_id").agg(F.count_if("new").alias("n_sessions"), F.count("*").alias("n"))


@register("a49_compared_periods", with_views("ord", "select entity_id, channel as label, p as period, a as amount, b as previous, a - b as change from (select entity_id, channel, year(day)::int as p, sum(total)::bigint as a, lag(sum(total)::bigint) over w as b, row_number() over (partition by entity_id, channel order by year(day) desc) as r from ord group by entity_id, channel, year(day) window w as (partition by entity_id, channel order by year(day))) where r = 1 and b is not null"))
def a49(b):
    return search.compared_periods(b.order().groupBy("entity_id", F.col("channel").alias("label"), F.year("day").alias("period")).agg(F.sum("total").alias("amount")))


@register("a53_flagged_rows", with_views("bank_line", "select flag, rank::int as rank, line_id, day, amount from (select *, row_number() over (partition by flag order by abs(amount) desc, day, line_id) as rank from (select *, unnest(list_filter([case when amount < 0 then 'OUT' end, case when k > 90 then 'HIGH' end], lambda x: x is not null)) as flag from bank_line)) where rank <= 15"))
def a53(b):
    flags = F.array_compact(F.array(F.when(F.col("amount") < 0, "OUT"), F.when(F.col("k") > 90, "HIGH")))
    return search.flagged_rows(b.bank_line(), flags, 15)


@register("a51_voted_types", "select digit, type, n, total from (select digit, type, n, sum(n) over (partition by digit)::bigint as total, row_number() over (partition by digit order by n desc, type desc) as r from (select p_partkey % 10 as digit, case when p_size > 10 then 'LARGE' else p_type end as type, count(*) as n from part group by all)) where r = 1 and total >= 3 and n * 100 >= total * 78")
def a51(b):
    return search.voted_types(b.read("part").select((F.col("p_partkey") % 10).alias("digit"), F.when(F.col("p_size") > 10, "LARGE").otherwise(F.col("p_type")).alias("type")), percent=78)
