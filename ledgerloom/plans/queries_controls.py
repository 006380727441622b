"""Checks of openings and of bank accounts in other entities' books."""

from pyspark.sql import functions as F

from ..operators import controls as c
from .catalog import register
from .oracle import with_views

NUMBER = "try_cast(regexp_extract(entry_id, '[0-9]+', 0) as bigint)"


def opened(b):
    """The journal, in which some entities have an opening: of every third a difference is left, of every fourth its first purchases are one."""
    n = F.expr(NUMBER)
    rows = b.journal_line().withColumn("account", F.when((F.col("entity_id") % 3 == 0) & (n % 97 == 0) & (F.col("account") == "2100"), "3290").otherwise(F.col("account")))
    kind = F.when((F.col("entity_id") % 4 == 0) & (n % 11 == 0) & (F.col("entry_kind") == "MANUAL"), "OPENING").otherwise(F.col("entry_kind"))
    return rows.withColumn("entry_kind", kind)


@register(
    "a47_opening_controls",
    with_views(
        "journal",
        """with x as (select *, try_cast(regexp_extract(entry_id, '[0-9]+', 0) as bigint) as n from journal),
        y as (select entity_id, day, debit, credit, case when entity_id % 3 = 0 and n % 97 = 0 and account = '2100' then '3290' else account end as account, entity_id % 4 = 0 and n % 11 = 0 and entry_kind = 'MANUAL' as opening from x),
        s as (select entity_id, sum(case when account = '3290' and day <= date '1992-01-31' then debit - credit else 0 end)::bigint as held, min(day) as first, bool_or(opening) as opening from y group by 1)
        select entity_id, 'OPENING_DIFFERENCE' as check_key, case when held <> 0 then 'FAIL' else 'PASS' end as status, abs(held) as amount from s where first <= date '1992-01-31'
        union all select entity_id, 'OPENING_RECORDED', case when not opening and first >= date '1992-01-01' then 'REVIEW' else 'PASS' end, 0 from s where first <= date '1992-01-31'""",
    ),
)
def opening(b):
    return c.opening_controls(opened(b), "1992-01-01", "1992-01-31")


@register(
    "a47_foreign_banks",
    with_views(
        "journal",
        """with x as (select *, try_cast(regexp_extract(entry_id, '[0-9]+', 0) as bigint) as n from journal where account = '1100' and day <= date '1996-12-31'),
        y as (select entity_id, debit - credit as net, case when entry_id[1] = 'U' and n % 50 = 0 then (entity_id + 20) % 25 else entity_id end as owner from x),
        s as (select entity_id, owner, sum(net)::bigint as net from y where owner <> entity_id group by all having sum(net) <> 0)
        select entity_id, sum(net)::bigint as amount, string_agg('11' || lpad(owner::varchar, 2, '0'), ', ' order by owner) as accounts from s group by 1""",
    ),
)
def foreign(b):
    """Each entity has a bank account of its own; of every fiftieth order what a partner received went to another's."""
    n, e = F.expr(NUMBER), F.col("entity_id")
    owner = F.when(F.col("entry_id").startswith("U") & (n % 50 == 0), (e + 20) % 25).otherwise(e)
    of = lambda k: F.concat(F.lit("11"), F.lpad(k.cast("string"), 2, "0"))
    lines = b.journal_line(("1100",)).withColumn("account", of(owner))
    return c.foreign_banks(lines, b.entity().select("entity_id", of(e).alias("account")), "1996-12-31")
