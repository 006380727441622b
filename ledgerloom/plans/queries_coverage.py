"""Purchases as prepayments and assets, and the schedules made from some of them."""

from pyspark.sql import functions as F

from ..operators import coverage as c
from .catalog import register
from .oracle import with_views


@register(
    "j24_covered_lines",
    with_views(
        "journal",
        """with x as (select entity_id, entry_id, account, debit - credit as net, entry_id[2:]::bigint as n, account = '1200' and entry_id[2:]::bigint % 2 = 1 as fixed from journal where entry_kind = 'MANUAL' and account in ('1200', '2100')),
        s as (select *, n % 6 = 0 or n % 6 = 1 or n % 6 = 3 as made from x)
        select entity_id, entry_id, case when account = '1200' then case when fixed then '1210' else '1170' end else '2160' end as account, net::bigint as net,
               case when n % 6 = 0 and account = '1200' then n when n % 6 = 1 and account = '1200' then n when n % 6 = 3 and account = '2100' then n end as schedule_id from s""",
    ),
)
def j24(b):
    """Even orders buy prepayments and odd ones assets, partly paid in advance by others: a release of every sixth, a depreciation
    with a memo of its own, and one that names the account of the money received."""
    n = F.expr("try_cast(substring(entry_id, 2) as bigint)")
    rows = b.journal_line(("1200", "2100")).filter("entry_kind = 'MANUAL'").withColumn("n", n)
    fixed = F.col("n") % 2 == 1
    code = F.when(F.col("account") == "2100", "2160").when(fixed, "1210").otherwise("1170")
    kind = F.when(F.col("account") == "2100", "DEFERRED").when(fixed, c.FIXED).otherwise(c.PREPAID)
    lines = rows.withColumn("account_name", F.concat(F.lit("Name of "), code)).withColumn("fs_line", kind).withColumn("line_id", F.col("account")).withColumn("account", code)
    m = F.col("n") % 6
    made = b.order().withColumn("n", F.col("order_id")).filter(m.isin(0, 1, 3)).select(
        F.col("n").alias("schedule_id"), "entity_id", F.concat(F.lit("P"), F.col("n").cast("string")).alias("entry_id"), F.lit(None).cast("string").alias("source_account"),
        F.when(m == 0, "PREPAYMENT").otherwise("DEPRECIATION").alias("kind"), F.when(m == 3, "2160").otherwise("6180").alias("debit_account"), F.when(m == 0, "1170").otherwise("1219").alias("credit_account"),
        F.lit(1).cast("long").alias("amount"), F.when(m == 3, "about the Name of 2160").otherwise("custom").alias("memo"),
    )
    return c.covered_lines(lines.select("entity_id", "entry_id", "line_id", "account", "account_name", "fs_line", "debit", "credit"), made)
