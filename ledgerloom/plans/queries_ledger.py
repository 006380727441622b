"""Statements from the journal (balances, income, equity, cash flow, controls on them)."""

from pyspark.sql import functions as F

from ..operators import currency as fx
from ..operators import ledger as gl
from .catalog import register
from .model import CHART
from .oracle import with_views

AS_OF = "1998-06-30"
YEAR = "1998-01-01"


@register("a1_sum_by_account", with_views("journal", "select client_id, account, sum(debit)::bigint as debit, sum(credit)::bigint as credit from journal where day between date '1997-01-01' and date '{as_of}' group by all"))
def a1(b):
    return gl.sum_by_account(b.journal_line(), "1997-01-01", AS_OF)


@register("a1_sum_by_entity", with_views("journal", "select client_id, entity_id, account, sum(debit)::bigint as debit, sum(credit)::bigint as credit from journal where day <= date '{as_of}' group by all"))
def a1e(b):
    return gl.sum_by_account(b.journal_line(), None, AS_OF, by_entity=True)


@register("a2_trial_balance", with_views("tb", "select *, greatest(net, 0)::bigint as debit, greatest(-net, 0)::bigint as credit from tb"))
def a2(b):
    return gl.trial_balance(b.journal_line(), b.chart(), AS_OF)


@register(
    "a3_trial_balance_movement",
    with_views(
        "tb",
        """select tb.client_id, tb.account, net, coalesce(d, 0)::bigint as period_debit, coalesce(c, 0)::bigint as period_credit, (net - coalesce(d, 0) + coalesce(c, 0))::bigint as opening
        from tb left join (select client_id, account, sum(debit) as d, sum(credit) as c from journal where day between date '1998-06-01' and date '{as_of}' group by all) m
        on m.client_id = tb.client_id and m.account = tb.account""",
    ),
)
def a3(b):
    return gl.trial_balance_movement(b.journal_line(), b.chart(), "1998-06-01", AS_OF)


@register("a5_account_by_contact", with_views("journal", "select client_id, contact_id, sum(debit)::bigint as debit, sum(credit)::bigint as credit from journal where account = '1130' and day <= date '{as_of}' group by all having sum(debit) <> sum(credit)"))
def a5(b):
    return gl.by_contact(b.journal_line(), "1130", AS_OF)


LINES = """
    select client_id, line, sum(amount)::bigint as amount, count(*) as n_accounts from (
        select j.client_id, j.account,
               case when j.account = '7100' then 'UNMAPPED_EXPENSE' else any_value(a.fs_line) end as line,
               case when any_value(a.type) = 'INCOME' or j.account = '7100' then sum(j.credit - j.debit) else sum(j.debit - j.credit) end as amount
        from journal j join chart a on a.account = j.account
        where a.type in ('INCOME', 'EXPENSE') and j.day between date '1998-01-01' and date '{as_of}' group by j.client_id, j.account)
    group by all having sum(amount) <> 0"""


@register("a6_income_statement", with_views("journal chart", LINES))
def a6(b):
    return gl.income_lines(b.journal_line(), b.chart(), YEAR, AS_OF)


@register(
    "a6_income_totals",
    with_views(
        "journal chart",
        f"""select client_id, r as revenue, (r - c)::bigint as gross_profit, (r - c - o)::bigint as operating_profit, (r - c - o + x)::bigint as profit_before_tax, (r - c - o + x - t)::bigint as net_profit from (
        select client_id, coalesce(sum(amount) filter (line = 'REVENUE'), 0)::bigint as r, coalesce(sum(amount) filter (line = 'COGS'), 0) as c,
               coalesce(sum(amount) filter (line in ('SELLING', 'ADMIN')), 0) as o, coalesce(sum(amount) filter (line = 'TAX'), 0) as t,
               coalesce(sum(amount) filter (line in ('OTHER_INCOME', 'OTHER_EXPENSE', 'UNMAPPED_INCOME', 'UNMAPPED_EXPENSE')), 0) as x
        from ({LINES}) group by 1)""",
    ),
)
def a6t(b):
    return gl.income_totals(b.journal_line(), b.chart(), YEAR, AS_OF)


SHEET = """
    select {by}, section, line, sum(case when section = 'ASSET' then net else -net end)::bigint as amount from (
        select *, case when kind = 'INTERCOMPANY' and net < 0 then 'LIABILITY' when type in ('INCOME', 'EXPENSE') then 'EQUITY' else type end as section,
               case when kind = 'INTERCOMPANY' and net < 0 then 'INTERCOMPANY_PAYABLE' when type in ('INCOME', 'EXPENSE') then 'CURRENT_PROFIT' else fs_line end as line
        from {tb}) group by all having sum(net) <> 0 or line = 'CURRENT_PROFIT'"""


@register("a7_balance_sheet", with_views("tb", SHEET.replace("{by}", "client_id").replace("{tb}", "tb")))
def a7(b):
    return gl.balance_sheet(b.journal_line(), b.chart(), AS_OF)


@register(
    "a7_balance_check",
    with_views(
        "tbe",
        "select *, assets - liabilities - equity as difference from (select client_id, entity_id, coalesce(sum(amount) filter (section = 'ASSET'), 0)::bigint as assets, coalesce(sum(amount) filter (section = 'LIABILITY'), 0)::bigint as liabilities, coalesce(sum(amount) filter (section = 'EQUITY'), 0)::bigint as equity from ("
        + SHEET.replace("{by}", "client_id, entity_id").replace("{tb}", "tbe")
        + ") group by all)",
    ),
)
def a7c(b):
    return gl.balance_check(b.journal_line(), b.chart(), AS_OF)


@register("a8_unmapped_accounts", with_views("chart journal", "select account, type, fs_line from chart where account = '7100' and account in (select account from journal)"))
def a8(b):
    return gl.unmapped(b.chart().join(b.journal_line().select("account").distinct(), "account", "left_semi"))


@register(
    "a9_combined_worksheet",
    with_views(
        "tbe",
        """select client_id, account, 'ALL' as part, sum(net)::bigint as total, 0::bigint as elimination, sum(net)::bigint as combined from tbe where kind <> 'INTERCOMPANY' group by client_id, account having max(abs(net)) > 0
        union all select client_id, account, 'RECEIVABLE', p, -least(p, u), p - least(p, u) from (select client_id, account, sum(greatest(net, 0))::bigint as p, sum(greatest(-net, 0))::bigint as u from tbe where kind = 'INTERCOMPANY' group by all)
        union all select client_id, account, 'PAYABLE', -u, least(p, u), least(p, u) - u from (select client_id, account, sum(greatest(net, 0))::bigint as p, sum(greatest(-net, 0))::bigint as u from tbe where kind = 'INTERCOMPANY' group by all)""",
    ),
)
def a9(b):
    return gl.combined_worksheet(b.journal_line(), b.chart(), AS_OF)


@register(
    "a12_month_series",
    with_views(
        "journal chart",
        """select c.client_id, (c.m // 12)::int as year, (c.m % 12 + 1)::int as month,
               coalesce(sum(j.debit - j.credit) filter (a.fs_line = 'CASH'), 0)::bigint as cash,
               coalesce(sum(j.credit - j.debit) filter (a.type = 'INCOME' and j.month = c.m), 0)::bigint as revenue,
               coalesce(sum(j.debit - j.credit) filter (a.type = 'EXPENSE' and j.month = c.m), 0)::bigint as expense
        from (select distinct client_id, unnest(range(1998 * 12 + 0, 1998 * 12 + 6)) as m from journal) c
        join journal j on j.client_id = c.client_id and j.month <= c.m and j.day <= date '{as_of}' join chart a on a.account = j.account group by c.client_id, c.m""",
    ),
)
def a12(b):
    return gl.month_series(b.journal_line(), b.chart(), AS_OF)


@register(
    "a14_equity_changes",
    with_views(
        "journal chart",
        """with x as (
            select j.*, a.type, a.fs_line, j.credit - j.debit as n from journal j join chart a on a.account = j.account where j.day <= date '{as_of}'),
        r as (
            select client_id, 'OPENING' as row, case when type = 'EQUITY' then fs_line else 'RETAINED' end as fs_line, n from x where type in ('EQUITY', 'INCOME', 'EXPENSE') and day < date '1998-01-01'
            union all select client_id, case when type = 'EQUITY' then 'MOVEMENT' else 'PROFIT' end, case when type = 'EQUITY' then fs_line else 'RETAINED' end, n from x where type in ('EQUITY', 'INCOME', 'EXPENSE') and day >= date '1998-01-01')
        select client_id, row, fs_line, sum(n)::bigint as amount from (select * from r union all select client_id, 'CLOSING', fs_line, n from r) group by all having sum(n) <> 0""",
    ),
)
def a14(b):
    return gl.equity_changes(b.journal_line(), b.chart(), YEAR, AS_OF)


@register(
    "a15_asset_movement",
    with_views(
        "journal chart",
        """select client_id, account, o as opening, d as additions, c as deductions, (o + d - c)::bigint as closing from (
        select client_id, account, coalesce(sum(debit - credit) filter (day < date '1998-01-01'), 0)::bigint as o, coalesce(sum(debit) filter (day >= date '1998-01-01'), 0)::bigint as d,
               coalesce(sum(credit) filter (day >= date '1998-01-01'), 0)::bigint as c from journal where account = '1200' and day <= date '{as_of}' group by all)""",
    ),
)
def a15(b):
    return gl.asset_movement(b.journal_line(), b.chart(), "INVENTORY", YEAR, AS_OF)


@register(
    "a17_indirect_cash_flow",
    with_views(
        "journal chart",
        """select client_id, section, case when type in ('INCOME', 'EXPENSE') then 'PROFIT' else fs_line end as line, sum(case when section = 'CASH' then debit - credit else credit - debit end)::bigint as amount
        from (select j.*, a.type, a.fs_line, case when fs_line = 'CASH' then 'CASH' when fs_line = 'FIXED_ASSETS' then 'INVESTING' when type = 'EQUITY' or fs_line = 'INTERCOMPANY' then 'FINANCING' else 'OPERATING' end as section
              from journal j join chart a on a.account = j.account where day between date '1998-01-01' and date '{as_of}') group by all""",
    ),
)
def a17(b):
    return gl.indirect_cash_flow(b.journal_line(), b.chart(), YEAR, AS_OF)


@register(
    "a19_account_ledger",
    with_views(
        "journal",
        """select entity_id, day, entry_id, debit, credit, balance from (
        select entity_id, day, entry_id, sum(debit)::bigint as debit, sum(credit)::bigint as credit,
               (sum(sum(debit - credit)) over (partition by entity_id order by day, entry_id))::bigint as balance
        from journal where account = '1190' and day <= date '{as_of}' group by entity_id, day, entry_id) where day >= date '1998-01-01'""",
    ),
)
def a19(b):
    return gl.account_ledger(b.journal_line(("1190",)), "1190", YEAR, AS_OF)


@register("a20_tax_month", with_views("journal", "select client_id, account, sum(debit)::bigint as debit, sum(credit)::bigint as credit from journal where account in ('2130', '8100') and year(day) = 1998 and month(day) = 6 group by all"))
def a20(b):
    return gl.tax_month_summary(b.journal_line(), "1998-06-01")


@register("a22_origins", with_views("journal", "select client_id, account, count(*) filter (entry_kind = 'BANK') as n_bank, count(*) filter (entry_kind = 'INVOICE') as n_invoice, count(*) filter (entry_kind = 'MANUAL') as n_manual, 0::bigint as n_other from journal where day <= date '{as_of}' group by all"))
def a22(b):
    return gl.origins(b.journal_line(), AS_OF)


@register(
    "a23_management_summary",
    with_views(
        "journal chart",
        """select *, case when month_revenue > 0 then month_profit * 1000 // month_revenue end as month_margin, case when year_revenue > 0 then year_profit * 1000 // year_revenue end as year_margin from (
        select client_id, """
        + ", ".join(
            f"coalesce(sum(credit - debit) filter ({when}{cond}), 0)::bigint as {name}_{what}"
            for name, when in (("month", "month = 1998 * 12 + 5"), ("previous", "month = 1998 * 12 + 4"), ("year", "month between 1998 * 12 and 1998 * 12 + 5"))
            for what, cond in (("revenue", " and type = 'INCOME'"), ("profit", ""))
        )
        + " from journal join chart using (account) where type in ('INCOME', 'EXPENSE') group by 1)",
    ),
)
def a23(b):
    return gl.management(b.journal_line(), b.chart(), "1998-06-01")


LAYOUT = [(1, "REVENUE", 1), (2, "COGS", -1), (3, "REVENUE", 1), (3, "COGS", -1), (4, "SELLING", -1), (5, "REVENUE", 1), (5, "COGS", -1), (5, "SELLING", -1)]


@register(
    "a27_report_format",
    with_views(
        "journal chart",
        f"""select client_id, row_no, amount, sign(amount)::int * ((abs(amount) * 2 + 1000) // 2000) as thousands from (
        select client_id, row_no, sum(amount * sgn)::bigint as amount from ({LINES}) join (values {", ".join(map(str, LAYOUT))}) l(row_no, line, sgn) using (line) group by all)""",
    ),
)
def a27(b):
    return gl.report_format(b.journal_line(), b.chart(), b.spark.createDataFrame(LAYOUT, "row_no int, line string, sign int"), YEAR, AS_OF)


@register(
    "a36_flux",
    with_views(
        "journal chart",
        """with m as (
            select client_id, account, any_value(type) as type, month, sum(case when type in ('ASSET', 'EXPENSE') then debit - credit else credit - debit end)::bigint as n
            from journal join chart using (account) where month between 1998 * 12 + 2 and 1998 * 12 + 5 group by client_id, account, month),
        k as (
            select client_id, account, any_value(type) as type, entry_kind, month, sum(case when type in ('ASSET', 'EXPENSE') then debit - credit else credit - debit end)::bigint as n
            from journal join chart using (account) where month between 1998 * 12 + 2 and 1998 * 12 + 4 and type in ('INCOME', 'EXPENSE') group by client_id, account, entry_kind, month),
        v as (select client_id, sum(abs(n)) as volume from k group by 1),
        r as (
            select client_id, account, any_value(type) as type, coalesce(sum(n) filter (month = 1998 * 12 + 5), 0)::bigint as current, coalesce(sum(n) filter (month < 1998 * 12 + 5), 0)::bigint as before,
                   count(*) filter (month < 1998 * 12 + 5) as n_before, count(*) filter (month = 1998 * 12 + 5) as n_now
            from m group by 1, 2)
        select client_id, account, finding, current, before, current * 3 - before as change_times_n from (
            select r.*, case when n_now = 0 and n_before = 3 then 'DORMANT' when type in ('INCOME', 'EXPENSE') and current < 0 then 'FLIP'
                             when n_before >= 2 and abs(current * 3 - before) * 100 >= coalesce(volume, 0) and abs(current * 3 - before) * 2 >= abs(before) then 'FLUX' end as finding
            from r left join v using (client_id)) where finding is not null""",
    ),
)
def a36(b):
    return gl.flux(b.journal_line(), b.chart(), "1998-06-01")


RATES_OF = """h as (
        select j.entity_id, last_day(min(day)) as first, coalesce(bool_or(type in ('INCOME', 'EXPENSE') and year(day) = {year} and day <= date '{as_of}'), false) as busy
        from journal j join entity e on e.entity_id = j.entity_id join chart a on a.account = j.account where currency <> 'IDR' group by 1),
    g as (
        select entity_id, busy, (select max_by(rate, rate_date) from rates where kind = 'SPOT' and rate_date between date_trunc('month', date '{as_of}') and date '{as_of}') as closing,
               (select min_by(rate, rate_date) from rates where kind = 'AVERAGE' and rate_date >= date '{as_of}' and year(rate_date) = {year}) as mean,
               (select max_by(rate, rate_date) from rates where kind = 'SPOT' and rate_date between date_trunc('month', h.first) and h.first) as historical
        from h),
    er as (select entity_id, closing, case when mean is null and not busy then closing else mean end as average, historical, busy from g)"""


@register(
    "a10_translated_trial_balance",
    with_views(
        "tbe entity rates",
        f"""with {RATES_OF},
        f as (
            select t.client_id, t.entity_id, account, net * case when type in ('ASSET', 'LIABILITY') then closing when type = 'EQUITY' then historical else coalesce(average, 0) end as net
            from tbe t join er on er.entity_id = t.entity_id where closing is not null and historical is not null and (average is not null or not busy))
        select client_id, entity_id, account, sum(net)::bigint as net from (select * from f union all select client_id, entity_id, '3900', -sum(net) from f group by 1, 2) group by all""",
    ),
)
def a10(b):
    return fx.translated_trial_balance(b.journal_line(), b.chart(), b.entity(), b.rates(), AS_OF)


@register(
    "a11_entity_rates",
    with_views(
        "journal entity chart rates",
        f"""with {RATES_OF}
        select entity_id, closing, average, historical,
               concat_ws(',', case when closing is null then 'CLOSING' end, case when average is null and busy then 'AVERAGE' end, case when historical is null then 'HISTORICAL' end) as missing
        from er""",
        "1997-05-31",
    ),
)
def a11(b):
    return fx.entity_rates(b.journal_line(), b.chart(), b.entity(), b.rates(), "1997-05-31")


@register(
    "a44_revaluation",
    with_views(
        "journal entity chart rates",
        """select entity_id, account, sum(n)::bigint as balance, sum(n * spot)::bigint as carried, (sum(n) * 14900 - sum(n * spot))::bigint as difference, count(distinct day) filter (spot is null) as missing from (
        select j.entity_id, j.account, j.day, j.debit - j.credit as n, (select max_by(rate, rate_date) from rates r where r.kind = 'SPOT' and r.rate_date <= j.day) as spot
        from journal j join entity e on e.entity_id = j.entity_id join chart a on a.account = j.account where e.currency <> 'IDR' and a.kind = 'MONETARY' and j.day <= date '{as_of}') group by all""",
    ),
)
def a44(b):
    return fx.revaluation(b.journal_line(tuple(a for a, *_, kind in CHART if kind == "MONETARY")), b.chart(), b.entity(), b.rates(), AS_OF)


@register(
    "j8_rates_as_of",
    with_views(
        "ord rates",
        """select day, (select max_by(rate, rate_date) from rates where kind = 'SPOT' and rate_date <= day) as spot,
               (select max_by(rate, rate_date) from rates where kind = 'SPOT' and rate_date <= day and year(rate_date) = year(day) and month(rate_date) = month(day)) as closing,
               (select min_by(rate, rate_date) from rates where kind = 'AVERAGE' and rate_date >= day and year(rate_date) = year(day)) as average
        from (select distinct day from ord)""",
    ),
)
def j8(b):
    return fx.rates_as_of(b.order().select("day").distinct(), b.rates())


@register("m7_inverse_rates", with_views("ord", "select day as rate_date, ((10000000000 * 2 + rate) // (2 * rate))::bigint as inverse from (select day, max(total) // 1000 as rate from ord group by 1)"))
def m7(b):
    # the largest order of a day as its rate
    rates = b.order().groupBy(F.col("day").alias("rate_date")).agg(F.expr("max(total) div 1000").alias("rate")).withColumn("kind", F.lit("SPOT"))
    return fx.inverse_rates(rates)
