"""Proceeds collected, statements repaired by their balances, and files that overlap what is stored."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import div
from ..operators import proceeds as p
from ..operators import repair as r
from .catalog import register
from .oracle import with_views


def booked(b):
    """The journal's cash and receivables with line_id and the bank line behind an entry; sales of every seventh order are the proceeds."""
    lines = b.journal_line(("1100", "1130")).withColumn("line_id", F.concat_ws("-", "entry_id", "account"))
    bank_id = F.when(F.col("entry_id").startswith("C"), F.expr("try_cast(substring(entry_id, 2) as bigint)"))
    lines = lines.withColumn("bank_id", bank_id)
    order = F.expr("substring(entry_id, 2)")
    asked = lines.filter(F.col("entry_id").startswith("S") & (F.substring_index(order, "-", 1).cast("long") % 7 == 0) & (F.col("account") == "1130"))
    paid = F.when(F.col("status") == "F", F.col("total")).when(F.col("status") == "P", div("total", 2))
    # a part of what the bank line settles is not cash
    bank = b.order().select(F.col("order_id").alias("bank_id"), (paid - F.when(F.col("order_id") % 3 == 0, div(paid, 10)).otherwise(0)).alias("amount")).filter("amount is not null")
    return lines.drop("client_id", "entry_kind", "month", "contact_id"), asked.select("line_id", "account"), bank


@register(
    "a18_collected_proceeds",
    with_views(
        "journal ord",
        """with l as (select *, entry_id || '-' || account as line_id, debit - credit as net from journal where account = '1130' and day <= date '1997-12-31'),
        g as (select order_id, case status when 'F' then total when 'P' then total // 2 end as paid from ord),
        a as (select l.*, case when entry_id[1] = 'C' then least(credit, paid - case when order_id % 3 = 0 then paid // 10 else 0 end) else 0 end as cash,
                     sum(greatest(net, 0)) over w - greatest(net, 0) as d0, sum(greatest(-net, 0)) over w - greatest(-net, 0) as c0
              from l left join g on entry_id[1] = 'C' and order_id = try_cast(entry_id[2:] as bigint) window w as (partition by entity_id order by day, line_id rows unbounded preceding))
        select d.line_id, sum(least(d.d0 + d.net, c.c0 + c.cash) - greatest(d.d0, c.c0))::bigint as collected
        from a d join a c on c.entity_id = d.entity_id and c.cash > 0 and (c.day, c.line_id) > (d.day, d.line_id) and c.c0 < d.d0 + d.net and d.d0 < c.c0 + c.cash
        where d.net > 0 and d.entry_id[1] = 'S' and string_split(d.entry_id[2:], '-')[1]::bigint % 7 = 0 group by 1""",
    ),
)
def a18(b):
    lines, asked, bank = booked(b)
    return p.collected_proceeds(lines, asked, bank, b.chart(), "1997-12-31")


@register("a18_reclassed_proceeds")  # what is taken back hangs on all before it: tests hold it against a loop
def a18_reclassed(b):
    lines, asked, bank = booked(b)
    moved = lines.filter("entry_id like 'C%' and account = '1130' and bank_id % 11 = 0")
    moved = moved.withColumns({"debit": div("credit", 2), "credit": F.lit(0).cast("long"), "day": F.date_add("day", 40), "entry_id": F.concat(F.lit("K"), "entry_id"), "line_id": F.concat(F.lit("K"), "line_id")})
    return p.collected_proceeds(lines.unionByName(moved), asked, bank, b.chart(), "1997-12-31")


def statements(b):
    """The bank lines as monthly files of an account, with a direction or an amount lost here and there."""
    n, own = F.col("line_id"), Window.partitionBy("bank_account").orderBy("line_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = b.bank_line().withColumn("at", F.sum("amount").over(own)).withColumn("file_id", F.concat_ws("-", "bank_account", F.date_format("day", "yyyy-MM")))
    file = Window.partitionBy("file_id").orderBy("line_id")
    whole = file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opening = F.first(F.col("at") - F.col("amount")).over(whole)
    closing = F.last("at").over(whole) + F.when(F.col("bank_account") == 5, 1).otherwise(0)
    rows = rows.withColumn("opening", opening).withColumn("closing", closing).withColumn("balance", F.when(n % 3 != 0, F.col("at")))
    lost = F.when((n % 500 == 2) & (n % 3 != 0), 0).when((n % 500 == 7) & (n % 3 != 0), -F.col("amount")).otherwise(F.col("amount"))
    return rows.withColumn("balance_only", (n % 500 == 2) & (n % 3 != 0)).withColumn("amount", lost.cast("long"))


FILES = """a as (select *, sum(amount) over (partition by bank_account order by line_id) as run, bank_account || '-' || strftime(day, '%Y-%m') as file_id from bank_line),
    f as (select file_id, line_id, bank_account, amount as true_amount, line_id % 500 = 2 and line_id % 3 <> 0 as lone,
                 case when line_id % 500 = 2 and line_id % 3 <> 0 then 0 when line_id % 500 = 7 and line_id % 3 <> 0 then -amount else amount end as amount, case when line_id % 3 <> 0 then run end as balance,
                 first_value(run - amount) over w as opening, last_value(run) over (partition by file_id order by line_id rows between unbounded preceding and unbounded following) + case when bank_account = 5 then 1 else 0 end as closing
          from a window w as (partition by file_id order by line_id))"""


@register(
    "p7_repaired_rows",
    with_views(
        "bank_line",
        f"""with {FILES},
        p as (select *, coalesce(max(case when balance is not null and not lone then line_id end) over (partition by file_id), 0) > line_id as proof,
                     coalesce(last_value(balance ignore nulls) over (partition by file_id order by line_id rows between unbounded preceding and 1 preceding), opening) as base,
                     count(balance) over (partition by file_id order by line_id rows between unbounded preceding and 1 preceding) as island from f),
        q as (select *, base + coalesce(sum(amount) over (partition by file_id, island order by line_id rows between unbounded preceding and 1 preceding), 0) as start from p),
        t as (select *, coalesce(lone and balance <> start, false) as moved, coalesce(not lone and amount <> 0 and balance <> start + amount and balance = start - amount, false) as flip, coalesce(balance <> start + amount, false) as broken from q),
        h as (select file_id, bool_or((moved or flip) and proof) and not bool_or(broken and not ((moved or flip) and proof)) and arg_max(coalesce(balance, start + amount), line_id) = max(closing) as holds from t group by 1)
        select file_id, line_id, amount::bigint as written, note, (case note when 'AMOUNT' then balance - start when 'FLIPPED' then -amount else amount end)::bigint as amount
        from (select t.*, case when holds and proof and moved then 'AMOUNT' when holds and proof and flip then 'FLIPPED' when holds then null when moved then 'AMOUNT_UNPROVED' when flip then 'FLIP_UNPROVED' end as note
              from t join h using (file_id) where not lone or moved)""",
    ),
)
def p7(b):
    return r.repaired_rows(statements(b), "file_id", "line_id").select("file_id", "line_id", "written", "note", "amount")


@register("j15_overlapping_rows")  # a day's chain is of unknown length: tests hold it against worked examples
def j15(b):
    n, own = F.col("line_id"), Window.partitionBy("bank_account").orderBy("line_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = b.bank_line().withColumn("balance", F.sum("amount").over(own)).withColumn("hash", F.concat(F.lit("h"), "line_id"))
    source = F.concat_ws("-", "bank_account", F.date_format("day", "yyyy-MM"))
    # months are stored but for some lines of their last days; every other account sends them again from another source
    stored = rows.filter((F.dayofmonth("day") <= 20) | (n % 6 != 0)).select(n.alias("stored_id"), "bank_account", "day", "amount", "balance", "hash", source.alias("source_hash"))
    files = rows.withColumn("file_id", source).withColumn("source_hash", F.when(F.col("bank_account") % 2 == 0, source).otherwise(F.concat(F.lit("again-"), source)))
    whole = Window.partitionBy("file_id")
    files = files.withColumns({"first_day": F.min("day").over(whole), "last_day": F.max("day").over(whole), "opening": F.lit(None).cast("long")})
    return r.overlapping_rows(files.select("file_id", "bank_account", n.alias("row_no"), "day", "amount", "balance", "hash", F.lit(None).cast("string").alias("written_hash"), "source_hash", "opening", "first_day", "last_day"), stored)
