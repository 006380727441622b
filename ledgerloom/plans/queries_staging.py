"""Ledger files derived from the journal, staged, and trial balances with columns left out."""

from pyspark.sql import functions as F

from ..operators import staging as st
from .catalog import register
from .oracle import with_views

OWN = ["IDR", "USD"]


def files(b):
    """Purchases and their payments as files by entity: cents that IDR has no use for, every fifth line in USD, some sides negative, some rows unreadable."""
    rows = b.journal_line().filter("entry_kind = 'MANUAL' and year(day) = 1995").withColumn("n", F.expr("try_cast(substring(entry_id, 2) as bigint)"))
    own = F.when(F.col("entity_id") % 2 == 0, "IDR").otherwise("USD")
    n, usd = F.col("n"), (F.col("n") % 5 == 0) & (F.col("account") != "2100")
    debit = F.when((n % 7 == 0) & (F.col("account") == "1100"), -F.col("credit")).otherwise(F.col("debit"))
    credit = F.when((n % 7 == 0) & (F.col("account") == "1100"), 0).when((n % 23 == 0) & (F.col("account") == "2100"), F.col("credit") + 300).otherwise(F.col("credit"))
    row = F.concat(F.lpad(n.cast("string"), 9, "0"), F.col("account"))
    rows = rows.select(
        F.concat(F.lit("file "), "entity_id").alias("file_id"), F.lit(None).cast("int").alias("row_no"), F.when(n % 301 == 0, "elsewhere").otherwise(own).alias("entity_key"), "day",
        F.col("account").alias("code"), F.concat(F.lit("account "), "account").alias("name"), debit.alias("debit"), credit.cast("long").alias("credit"), F.when(usd, "USD").alias("currency"),
        F.when(usd, 230_050).cast("long").alias("rate_num"), F.when(usd, 2).alias("rate_scale"), "entry_id", row.alias("_row"), n.alias("_n"),
    )
    rows = rows.withColumn("voucher", F.col("entry_id")).withColumn("error", F.when(F.col("_n") % 211 == 0, "no date")).drop("entry_id")
    return rows.withColumn("row_no", F.pmod(F.xxhash64("_row"), F.lit(10**9)).cast("int")).drop("_row", "_n"), b.spark.createDataFrame([(k, k) for k in OWN], "entity_key string, currency string")


STAGED = """j as (select *, entry_id[2:]::bigint as n from journal where entry_kind = 'MANUAL' and year(day) = 1995),
    x as (select 'file ' || entity_id as file_id, case when entity_id % 2 = 0 then 'IDR' else 'USD' end as own, day, entry_id as voucher, n % 5 = 0 and account <> '2100' as usd,
                 case when n % 7 = 0 and account = '1100' then -credit else debit - (credit + case when n % 23 = 0 and account = '2100' then 300 else 0 end) end as signed
          from j where n % 301 <> 0 and n % 211 <> 0),
    m as (select *, usd and own = 'IDR' as foreign_, signed as cents0 from x),
    c as (select *, case when foreign_ then sign(signed) * ((abs(signed)::hugeint * 230050 * 2 + 10000) // 20000) when own = 'IDR' then sign(signed) * ((abs(signed) * 2 + 100) // 200) else signed end as amount from m),
    g as (select file_id, own, voucher, day, count(*) as n_rows, sum(amount) as s, sum(greatest(amount, 0)) as debit, sum(case when foreign_ then amount * 100 else signed end) as cents, count(*) filter (foreign_) as conv,
                 sum(case when foreign_ then signed else 0 end) = 0 and sum(case when foreign_ then 0 else signed end) = 0 as even from c group by all),
    t as (select *, case when own = 'IDR' then sign(cents) * ((abs(cents) * 2 + 100) // 200) else cents end as whole from g),
    e as (select *, conv > 0 and whole <> 0 and abs(whole) <= conv and even as fx from t)"""


@register(
    "t5_planned_entries",
    with_views(
        "journal",
        f"""with {STAGED}
        select file_id, own as entity_key, voucher, day, n_rows, debit::bigint as debit, (whole - s - case when fx then whole else 0 end)::bigint as rounding, fx as fx_rounding, (case when fx then 0 else whole end)::bigint as imbalance from e""",
    ),
)
def t5(b):
    rows, entities = files(b)
    none = b.spark.createDataFrame([], "currency string, to string, day date, rate_num long, rate_scale int")
    return st.planned_entries(rows, entities, none)[0]


@register(
    "t5_rounding_lines",
    with_views("journal", f"with {STAGED} select file_id, voucher, day, '7190' as code, (whole - s - case when fx then whole else 0 end)::bigint as amount from e where whole - s - case when fx then whole else 0 end <> 0"),
)
def t5_rounding(b):
    rows, entities = files(b)
    none = b.spark.createDataFrame([], "currency string, to string, day date, rate_num long, rate_scale int")
    return st.planned_entries(rows, entities, none)[1].filter("row_no is null").select("file_id", "voucher", "day", "code", "amount")


@register(
    "t5_findings_by_kind",
    with_views(
        "journal",
        f"""with {STAGED}
        select file_id, 'BLOCK' as severity, 'UNBALANCED' as code, count(*) as n, sum(n_rows)::bigint as n_rows from e where not fx and whole <> 0 group by 1
        union all select 'file ' || entity_id, 'BLOCK', 'ROW_ERROR', count(distinct case when n % 301 = 0 then 'elsewhere' else 'own' end), count(*) from j where n % 211 = 0 group by 1
        union all select 'file ' || entity_id, 'BLOCK', 'UNKNOWN_ENTITY', 1, count(*) from j where n % 301 = 0 group by 1
        union all select 'file ' || entity_id, 'REVIEW', 'NEGATIVE_AMOUNT', 1, count(*) from j where n % 301 <> 0 and n % 211 <> 0 and n % 7 = 0 and account = '1100' group by 1""",
    ),
)
def t5_findings(b):
    rows, entities = files(b)
    none = b.spark.createDataFrame([], "currency string, to string, day date, rate_num long, rate_scale int")
    found = st.staging_findings(rows, entities, none).filter("code in ('UNBALANCED', 'ROW_ERROR', 'UNKNOWN_ENTITY', 'NEGATIVE_AMOUNT')")
    return found.groupBy("file_id", "severity", "code").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))


@register(
    "r16_trial_balance_parts",
    with_views(
        "journal",
        """with s as (select client_id, account, sum(case when day < date '1996-01-01' then debit - credit else 0 end)::bigint as opening, sum(case when day >= date '1996-01-01' and day < date '1996-07-01' then debit - credit else 0 end)::bigint as adjustment,
                     sum(case when day >= date '1996-07-01' and day < date '1997-01-01' then debit - credit else 0 end)::bigint as movement from journal where day < date '1997-01-01' group by all)
        select client_id as file_id, account as code, case client_id when 4 then opening + adjustment else opening end as opening, case client_id when 4 then 0 else adjustment end as adjustment,
               opening + adjustment as adjusted, movement, opening + adjustment + movement + case when client_id = 0 and account = '1200' then 1 else 0 end as closing,
               case when client_id = 0 and account = '1200' then 'CLOSING' end as problem from s""",
    ),
)
def r16(b):
    """A file per client, each with other columns: all of them, no adjustment, no opening, neither adjusted nor closing, only movement and closing."""
    span = lambda lo, hi: F.sum(F.when((F.col("day") >= lo) & (F.col("day") < hi), F.col("debit") - F.col("credit")).otherwise(0))
    rows = b.journal_line().filter("day < date'1997-01-01'").groupBy(F.col("client_id").alias("file_id"), F.col("account").alias("code")).agg(
        span("1900-01-01", "1996-01-01").alias("o"), span("1996-01-01", "1996-07-01").alias("a"), span("1996-07-01", "1997-01-01").alias("m")
    )
    f, has = F.col("file_id"), lambda c, *ids: F.when(F.col("file_id").isin(*ids), c)
    slip = F.when((f == 0) & (F.col("code") == "1200"), 1).otherwise(0)
    rows = rows.select(
        f, "code", has(F.col("o"), 0, 1, 3).alias("opening"), F.lit(None).cast("long").alias("unadjusted"), has(F.col("a"), 0, 2, 3).alias("adjustment"),
        has(F.col("o") + F.col("a"), 0, 1, 2).alias("adjusted"), has(F.col("m"), 0, 1, 2, 3, 4).alias("movement"), has(F.col("o") + F.col("a") + F.col("m") + slip, 0, 4).alias("closing"),
    )
    return st.trial_balance_parts(rows)
