"""Amounts and rates as people type them, derived from orders."""

from pyspark.sql import functions as F

from ..functions import money as m
from .catalog import register


@register(
    "m9_formatted_money",
    """select o_orderkey, case when v < 0 then '(' || s || ')' else s end as shown from (
        select o_orderkey, v, case when o_orderkey % 2 = 0 then 'Rp ' || replace(format('{:,}', abs(v)), ',', '.') else 'S$ ' || replace(format('{:,}', abs(v) // 100), ',', '.') || ',' || lpad((abs(v) % 100)::varchar, 2, '0') end as s
        from (select o_orderkey, case when o_orderkey % 3 = 0 then -1 else 1 end * round(o_totalprice * 100)::bigint as v from orders))""",
)
def m9(b):
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, -1).otherwise(1) * m.cents("o_totalprice")
    rows = b.read("orders").select("o_orderkey", value.alias("v"), F.when(k % 2 == 0, "IDR").otherwise("SGD").alias("currency"))
    return rows.select("o_orderkey", m.format_money("v", "currency", accounting=True).alias("shown"))


@register(
    "m4_typed_amounts",
    """select o_orderkey, case when o_orderkey % 7 in (1, 2) then null when o_orderkey % 7 = 6 and t % 100 <> 0 then null when o_orderkey % 7 = 6 then t // 100 when o_orderkey % 7 = 5 then -t else t end as value,
              case when o_orderkey % 7 = 1 then 'FORM' when o_orderkey % 7 = 2 then 'UNSURE' when o_orderkey % 7 = 6 and t % 100 <> 0 then 'DECIMALS' end as problem
       from (select o_orderkey, round(o_totalprice * 100)::bigint as t from orders)""",
)
def m4(b):
    """Totals in several hands: plain, in English, unsure, with a code, in brackets, and cents where the currency has none."""
    k, total = F.col("o_orderkey"), m.cents("o_totalprice")
    rows = b.read("orders").select("o_orderkey", total.alias("t"))
    usd = m.format_money("t", F.lit("USD"), bare=True)
    text = (
        F.when(k % 7 == 0, m.format_money("t", F.lit("USD"))).when(k % 7 == 1, F.concat(m.div("t", 100).cast("string"), F.lit("."), F.lpad((F.col("t") % 100).cast("string"), 2, "0")))
        .when(k % 7 == 2, F.concat((F.col("t") % 900 + 100).cast("string"), F.lit(",000"))).when(k % 7 == 3, usd).when(k % 7 == 4, F.concat(F.lit("usd "), usd))
        .when(k % 7 == 5, F.concat(F.lit("("), usd, F.lit(")"))).otherwise(usd)
    )
    rows = rows.withColumn("text", text).withColumn("currency", F.when(k % 7 == 6, "IDR").otherwise("USD"))
    value, problem = m.strict_money("text", "currency")
    return rows.select("o_orderkey", value.alias("value"), problem.alias("problem"))


@register(
    "m8_typed_rates",
    """select o_orderkey, case o_orderkey % 4 when 0 then (10000 + o_orderkey % 900)::varchar when 1 then (10 + o_orderkey % 80)::varchar || '.' || lpad((o_orderkey % 1000)::varchar, 3, '0')
                                     when 2 then '1.' || lpad((o_orderkey % 1000)::varchar, 3, '0') else (10000 + o_orderkey % 900)::varchar || '.50' end as rate
       from orders where not (o_orderkey % 4 = 1 and 10 + o_orderkey % 80 < 20)""",
)
def m8(b):
    """Rates of four pairs: thousands in groups, decimals of three places that only the band tells apart, a foreign pair, and both separators."""
    k = F.col("o_orderkey")
    number, three = (10000 + k % 900).cast("string"), F.lpad((k % 1000).cast("string"), 3, "0")
    grouped = F.concat(F.substring(number, 1, 2), F.lit("."), F.substring(number, 3, 3))
    text = F.when(k % 4 == 0, grouped).when(k % 4 == 1, F.concat((10 + k % 80).cast("string"), F.lit("."), three)).when(k % 4 == 2, F.concat(F.lit("1."), three)).otherwise(F.concat(grouped, F.lit(",50")))
    currency = F.when(k % 4 == 1, "JPY").when(k % 4 == 2, "EUR").otherwise("USD")
    rows = b.read("orders").filter(~((k % 4 == 1) & (10 + k % 80 < 20))).select("o_orderkey", text.alias("text"), currency.alias("currency"), F.when(k % 4 == 2, "USD").otherwise("IDR").alias("quote"))
    return rows.select("o_orderkey", m.normal_rate("text", "currency", "quote").alias("rate"))
