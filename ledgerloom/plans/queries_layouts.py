"""How files write their cells and dates, from lines made of customers' orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import statements as s
from .catalog import register


def dated(b):
    """A file per customer, of their orders by day (newest first for odd customers): days first, months first, the same with days
    up to 12 only, both in turn, and short days without an order in time."""
    c, day = F.col("o_custkey"), F.to_date("o_orderdate")
    kind = c % 6
    rows = b.read("orders").select(c, F.col("o_orderkey"), day.alias("day"), kind.alias("kind")).filter((kind.isin(0, 1, 4)) | (F.dayofmonth("day") <= 12))
    order = F.when(F.col("kind") == 5, F.col("o_orderkey") * 7919 % 1009).when(c % 4 < 2, F.date_diff("day", F.lit("1990-01-01").cast("date"))).otherwise(-F.date_diff("day", F.lit("1990-01-01").cast("date")))
    rows = rows.withColumn("row_number", F.row_number().over(Window.partitionBy("o_custkey").orderBy(order, "o_orderkey")).cast("long"))
    month = (F.col("kind").isin(1, 3)) | ((F.col("kind") == 4) & (F.col("o_orderkey") % 2 == 0))
    text = F.when(month, F.date_format("day", "MM/dd/yyyy")).when(F.col("kind") == 5, F.date_format("day", "d-M-yy")).otherwise(F.concat(F.lit("'"), F.date_format("day", "dd/MM/yyyy"), F.lit(" 09:30")))
    return rows.select(c.alias("file"), "row_number", text.alias("date_text"))


@register(
    "s13_date_orders",
    """with o as (select o_custkey as file, o_orderkey as k, o_orderdate::date as day, o_custkey % 6 as kind from orders where o_custkey % 6 in (0, 1, 4) or day(o_orderdate::date) <= 12),
    r as (
        select *, row_number() over (partition by file order by case when kind = 5 then k * 7919 % 1009 when file % 4 < 2 then day - date '1990-01-01' else date '1990-01-01' - day end, k) as n,
               kind in (1, 3) or (kind = 4 and k % 2 = 0) as months from o),
    t as (
        select *, case when months then strftime(day, '%m/%d/%Y') when kind = 5 then strftime(day, '%-d-%-m-%y') else strftime(day, '%d/%m/%Y') || ' 09:30' end as t,
               case when months then month(day) else day(day) end as a, case when months then day(day) else month(day) end as b, case when kind = 5 and not months then 2000 + year(day) % 100 else year(day) end as y from r),
    w as (
        select *, case when b <= 12 then y * 10000 + b * 100 + a end as dmy, case when a <= 12 then y * 10000 + a * 100 + b end as mdy from t),
    v as (
        select *, dmy - last_value(dmy ignore nulls) over p as dd, mdy - last_value(mdy ignore nulls) over p as md from w
        window p as (partition by file order by n rows between unbounded preceding and 1 preceding)),
    g as (
        select file, arg_min(t, n) filter (a > 12) as day_first, arg_min(t, n) filter (b > 12) as month_first, count(*) as n,
               coalesce(bool_and(dd >= 0), true) or coalesce(bool_and(dd <= 0), true) as d, coalesce(bool_and(md >= 0), true) or coalesce(bool_and(md <= 0), true) as m from v group by file)
    select file, case when day_first is not null and month_first is not null then 'MIXED' when day_first is not null then 'DMY' when month_first is not null then 'MDY'
                      when d then 'DMY' when m then 'MDY' else 'UNKNOWN' end as "order", day_first, month_first, n from g""",
)
def s13(b):
    return s.date_orders(dated(b))


@register(
    "s12_delimiters",
    """with o as (select o_custkey as file, o_orderkey as k, o_orderstatus as st, round(o_totalprice * 100)::bigint as c, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
    x as (select file, least(count(*), 10) as rows from o group by 1)
    select file, case file % 5 when 0 then ',' when 1 then ';' when 2 then chr(9) when 3 then ';' else case when rows >= 1 then ',' end end as separator from x""",
)
def s12(b):
    """A file per customer: a title with commas, a header, an order a line, with decimal commas or quoted cells that hold other separators."""
    c, k = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    price = F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"\.", ",")
    row = (
        F.when(c % 5 == 0, F.concat(k, F.lit(',"a;b;c;d;e;f",'), "o_orderstatus")).when(c % 5 == 1, F.concat_ws(";", k, price, "o_orderstatus"))
        .when(c % 5 == 2, F.concat_ws("\t", k, price, "o_orderstatus", F.lit("x;y"))).when(c % 5 == 3, F.concat(k, F.lit(';"1,2,3,4,5,6,7;";'), "o_orderstatus")).otherwise(F.concat_ws(",", k, "o_orderstatus", F.lit("a"), F.lit("b")))
    )
    rows = b.read("orders").select(c.alias("file"), "o_orderkey", row.alias("line"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey"))).filter("n <= 10")  # what the sniffer looks at
    head = F.when(F.col("file") % 5 == 0, "No,Text,Status").when(F.col("file") % 5 == 1, "No;Amount;Status").when(F.col("file") % 5 == 2, "No\tAmount\tStatus\tNote").when(F.col("file") % 5 == 3, "No;Text;Status").otherwise("No,S,A,B")
    files = rows.groupBy("file").agg(F.concat(F.array(F.lit("A statement, of orders"), F.lit(" "), F.first(head)), F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])).alias("lines"))
    return files.select("file", s.delimiter(F.col("lines")).alias("separator"))
