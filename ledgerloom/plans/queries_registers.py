"""Tax computations, schedules, assets and leases, with figures taken from the books."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as d
from ..functions import money as m
from ..operators import registers as reg
from ..operators import tax
from .catalog import register
from .oracle import with_views

PROFIT = "select entity_id, (sum(credit - debit) filter (account in ('4100', '5100', '6100', '7100')))::bigint as profit, coalesce(sum(credit) filter (account = '4100'), 0)::bigint as turnover from journal where year(day) = 1998 group by 1"


def profits(b):
    lines = b.journal_line().filter("year(day) = 1998 and account in ('4100', '5100', '6100', '7100')")
    return lines.groupBy("entity_id").agg(F.sum(F.col("credit") - F.col("debit")).alias("profit"), F.sum(F.when(F.col("account") == "4100", F.col("credit")).otherwise(0)).alias("turnover"))


@register(
    "m12_corporate_tax",
    with_views(
        "journal",
        f"""select *, due - withheld - instalments as balance, greatest(0, (due - withheld) // 12) as next_instalment, difference * 22 // 100 as deferred from (
        select *, eased * 22 // 200 + (taxable - eased) * 22 // 100 as due from (
        select *, case when turnover <= 0 then 0 when turnover <= 4800000000 then taxable when turnover <= 50000000000 then (taxable::hugeint * 4800000000 // turnover)::bigint else 0 end as eased from (
        select entity_id, profit, turnover, profit // 100 as withheld, profit // 50 as instalments, profit // 7 as difference, greatest(profit, 0) // 1000 * 1000 as taxable from ({PROFIT}))))""".replace("select *, eased * 22", "select * exclude (eased), eased * 22"),
    ),
)
def m12(b):
    return tax.corporate(profits(b).select("*", m.div("profit", 100).alias("withheld"), m.div("profit", 50).alias("instalments"), m.div("profit", 7).alias("difference")))


BRACKETS = [("A", 5_400_000, 0), ("A", 5_650_000, 25), ("A", 9_650_000, 175), ("A", 30_000_000, 900), ("A", None, 3400), ("B", 6_200_000, 0), ("B", 9_200_000, 100), ("B", None, 3400)]
SQL_BRACKETS = ", ".join(f"('{c}', {'null' if u is None else u}, {r})" for c, u, r in BRACKETS)
STATUSES = "['TK0', 'TK1', 'TK2', 'TK3', 'K0', 'K1', 'K2', 'K3']"
WAGES = f"select c_custkey as employee_id, case when c_custkey % 2 = 0 then 'A' else 'B' end as category, ({STATUSES})[c_custkey % 8 + 1] as status, (round(c_acctbal * 100)::bigint * 40) as wage from customer"


def wages(b):
    k = F.col("contact_id")
    status = F.element_at(F.array(*[F.lit(x) for x in tax.ALLOWANCES]), (k % 8 + 1).cast("int"))
    return b.contact().select(k.alias("employee_id"), F.when(k % 2 == 0, "A").otherwise("B").alias("category"), status.alias("status"), (F.col("advance") * 40).alias("wage"))


MONTHLY = f"select employee_id, category, wage, rate as rate_bp, case when wage > 0 then wage * rate // 10000 else 0 end as tax from (select w.*, (select min_by(rate, coalesce(u, 9000000000000000000)) from (values {SQL_BRACKETS}) t(c, u, rate) where c = w.category and (u is null or w.wage <= u)) as rate from ({WAGES}) w)"


@register("m14_monthly_wage_tax", MONTHLY)
def m14(b):
    return tax.monthly_wage_tax(wages(b).drop("status"), b.spark.createDataFrame(BRACKETS, "category string, upper long, rate_bp int"))


LAYER = " + ".join(f"greatest(0, {'least(taxable, ' + str(hi) + ')' if hi else 'taxable'} - {lo}) * {p} // 100" for lo, hi, p in ((0, 60_000_000, 5), (60_000_000, 250_000_000, 15), (250_000_000, 500_000_000, 25), (500_000_000, 5_000_000_000, 30), (5_000_000_000, None, 35)))
ALLOWED = "case status " + " ".join(f"when '{k}' then {v}" for k, v in tax.ALLOWANCES.items()) + " end"


@register(
    "m15_annual_wage_tax",
    f"""select *, annual - tax * 11 as december from (select *, {LAYER} as annual from (
    select *, greatest(0, gross - least(gross * 5 // 100, 6000000) - {ALLOWED}) // 1000 * 1000 as taxable from (
    select w.employee_id, w.category, w.status, w.wage, m.tax, greatest(w.wage, 0) * 12 as gross from ({WAGES}) w join ({MONTHLY}) m using (employee_id))))""",
)
def m15(b):
    monthly = tax.monthly_wage_tax(wages(b).drop("status"), b.spark.createDataFrame(BRACKETS, "category string, upper long, rate_bp int"))
    return tax.annual_wage_tax(wages(b).join(monthly.select("employee_id", "tax"), "employee_id"))


LOSSES = "select entity_id, year(day)::int as origin_year, sum(debit)::bigint as amount from journal where account = '7100' and year(day) < 1998 group by all"


@register(
    "w10_loss_use",
    with_views(
        "journal",
        f"""select entity_id, origin_year, amount, expired, used::bigint as used, (amount - used)::bigint as remaining from (
        select *, greatest(0, least(u, greatest(profit, 0) - coalesce(sum(u) over (partition by entity_id order by origin_year rows between unbounded preceding and 1 preceding), 0))) as used from (
        select l.*, p.profit // 20 as profit, origin_year + 5 < 2001 or origin_year >= 2001 as expired, case when origin_year + 5 < 2001 or origin_year >= 2001 then 0 else amount end as u from ({LOSSES}) l join ({PROFIT}) p using (entity_id)))""",
    ),
)
def w10(b):
    losses = b.journal_line().filter("account = '7100' and year(day) < 1998").groupBy("entity_id", F.year("day").alias("origin_year")).agg(F.sum("debit").alias("amount"))
    return tax.loss_use(losses, profits(b).select("entity_id", m.div("profit", 20).alias("profit")), 2001)


VAT = "select entity_id, year(day)::int as year, month(day)::int as month, coalesce(sum(credit) filter (account = '2130'), 0)::bigint as output, coalesce(sum(debit) filter (account = '1200'), 0)::bigint // 25 as input from journal where account in ('2130', '1200') group by all"


@register(
    "w7_vat_carry",
    with_views(
        "journal",
        f"""select entity_id, year, month, output, input, (output - input - coalesce(lag(carry) over (partition by entity_id, year order by month), 0))::bigint as net, carry::bigint as carry from (
        select *, list_reduce(list_prepend(0::bigint, list(input - output) over (partition by entity_id, year order by month)), lambda a, x: greatest(a + x, 0::bigint)) as carry from ({VAT}))""",
    ),
)
def w7(b):
    lines = b.journal_line(("2130", "1200"))
    rows = lines.groupBy("entity_id", F.year("day").alias("year"), F.month("day").alias("month")).agg(
        F.sum(F.when(F.col("account") == "2130", F.col("credit")).otherwise(0)).alias("output"), m.div(F.sum(F.when(F.col("account") == "1200", F.col("debit")).otherwise(0)), 25).alias("input")
    )
    return tax.vat_carry(rows)


@register(
    "w8_late_payments",
    with_views(
        "bank_line",
        """with o as (select entity_id, month(day)::int as month, (sum(amount) filter (amount > 0) // 2)::bigint as owed from bank_line group by all),
        p as (select entity_id, month(day)::int as month, line_id as payment_id, day, -amount as amount from bank_line where amount < 0)
        select p.entity_id, p.month, payment_id, day, amount, t::bigint as late, (amount - t)::bigint as ahead from (
        select p.*, greatest(0, least(amount, owed - coalesce(sum(amount) over (partition by p.entity_id, p.month order by day, payment_id rows between unbounded preceding and 1 preceding), 0))) as t from p join o on o.entity_id = p.entity_id and o.month = p.month) p""",
    ),
)
def w8(b):
    lines = b.bank_line().withColumn("month", F.month("day"))
    owed = lines.filter("amount > 0").groupBy("entity_id", "month").agg(m.div(F.sum("amount"), 2).alias("owed"))
    return tax.late_payments(owed, lines.filter("amount < 0").select("entity_id", "month", F.col("line_id").alias("payment_id"), "day", (-F.col("amount")).alias("amount")))


@register(
    "w9_instalments_by_month",
    with_views("bank_line", "select entity_id, coalesce(case when k > 50 then 24286 end, year(day) * 12 + month(day) - 2)::int as for_month, sum(-amount)::bigint as amount, count(*) as n from bank_line where amount < 0 group by all"),
)
def w9(b):
    rows = b.bank_line().filter("amount < 0").select("entity_id", "day", (-F.col("amount")).alias("amount"), F.when(F.col("k") > 50, 24286).alias("tax_month"))
    return tax.payments_by_tax_month(rows)


@register(
    "x4_monthly_tax_report",
    with_views(
        "journal",
        """select o.entity_id, owed, coalesce(paid, 0)::bigint as paid, date '1998-07-31' as due_on, case when owed = 0 and coalesce(paid, 0) = 0 then 'NIL' when coalesce(paid, 0) > owed then 'OVER' when coalesce(paid, 0) = owed then 'PAID' else 'SHORT' end as state
        from (select entity_id, sum(credit)::bigint as owed from journal where account = '1130' and year(day) = 1998 and month(day) = 6 group by 1) o
        left join (select entity_id, sum(debit) as paid from journal where account = '1130' and day between date '1998-07-01' and date '1998-07-31' group by 1) p on p.entity_id = o.entity_id""",
    ),
)
def x4(b):
    return tax.monthly_report(b.journal_line(), "1130", "1998-06-01")


@register(
    "u3_target_differences",
    with_views(
        "journal",
        """select * from (select coalesce(t.entity_id, p.entity_id) as entity_id, coalesce(t.account, p.account) as account, coalesce(target, 0)::bigint as target, coalesce(posted, 0)::bigint as posted, (coalesce(target, 0) - coalesce(posted, 0))::bigint as difference
        from (select entity_id, account, sum(debit - credit) // 10 as target from journal where account < '3000' group by all) t
        full join (select entity_id, account, sum(debit - credit) // 20 as posted from journal where account > '1150' and account < '3000' and entity_id % 3 = 0 group by all) p on p.entity_id = t.entity_id and p.account = t.account) where difference <> 0""",
    ),
)
def u3(b):
    sums = b.journal_line().filter("account < '3000'").groupBy("entity_id", "account").agg(F.sum(F.col("debit") - F.col("credit")).alias("n"))
    posted = sums.filter("account > '1150' and entity_id % 3 = 0").select("entity_id", "account", m.div("n", 20).alias("posted"))
    return tax.target_differences(sums.select("entity_id", "account", m.div("n", 10).alias("target")), posted)


SCHEDULES = "select p_partkey as schedule_id, (round(p_retailprice * 100)::bigint) as amount, (p_size % 24 + 1)::int as months, (1996 * 12 + p_partkey % 30)::int as start_month, p_size % 5 = 0 as reverse from part"


@register(
    "m20_installments",
    f"""select schedule_id, k::int as k, case when k > months then make_date((start_month + k - 1) // 12, (start_month + k - 1) % 12 + 1, 1) else last_day(make_date((start_month + k - 1) // 12, (start_month + k - 1) % 12 + 1, 1)) end as day,
        (case when k > months then amount when k = months then amount - amount // months * (months - 1) else amount // months end)::bigint as amount, k > months as reversal
    from (select *, unnest(range(1, months + 1 + reverse::int)) as k from ({SCHEDULES}))""",
)
def m20(b):
    p = b.read("part")
    return reg.installments(
        p.select(F.col("p_partkey").alias("schedule_id"), m.cents("p_retailprice").alias("amount"), (F.col("p_size") % 24 + 1).alias("months"), (1996 * 12 + F.col("p_partkey") % 30).cast("int").alias("start_month"), (F.col("p_size") % 5 == 0).alias("reverse"))
    )


GROUPS = "['GROUP_1', 'GROUP_2', 'GROUP_3', 'GROUP_4', 'BUILDING', 'LIGHT_BUILDING']"
FISCAL = f"""
    with recursive g as (select * from (values {", ".join("(" + ", ".join("null" if x is None else repr(x) for x in row) + ")" for row in reg.TAX_GROUPS)}) t(tax_group, life_years, straight_bp, declining_bp)),
    a as (select p_partkey as asset_id, ({GROUPS})[p_size % 6 + 1] as tax_group, case when p_partkey % 2 = 0 then 'DECLINING' else 'STRAIGHT' end as method, (date '1995-01-15' + (p_partkey % 40)::int * interval 1 month)::date as acquired_on, round(p_retailprice * 100000)::bigint as cost from part),
    x as (select a.*, year(acquired_on) * 12 + month(acquired_on) - 1 as f, year(acquired_on) * 12 + month(acquired_on) - 1 + life_years * 12 - 1 as l, method = 'DECLINING' and declining_bp is not null as dec, case when method = 'DECLINING' and declining_bp is not null then declining_bp else straight_bp end as bp from a join g using (tax_group)),
    y as (
        select asset_id, f, l, dec, bp, cost, f // 12 as year, 0::bigint as annual, cost as book_value, 0 as months, false as done from x
        union all
        select asset_id, f, l, dec, bp, cost, year + 1, an, (left_ - an)::bigint, mo, year * 12 + 11 >= l from (
            select *, (case when least(l, year * 12 + 11) = l then left_ else ((case when dec then left_ else cost end)::hugeint * bp * mo * 2 + 120000) // 240000 end)::bigint as an from (
            select asset_id, f, l, dec, bp, cost, year, book_value as left_, (least(l, year * 12 + 11) - greatest(f, year * 12) + 1)::int as mo from y where not done)))"""


@register("m18_fiscal_depreciation", FISCAL + " select asset_id, (year - 1)::int as year, months::int as months, annual, book_value from y where months > 0")
def m18(b):
    return reg.fiscal_years(assets(b), groups(b))


def groups(b):
    return b.spark.createDataFrame(reg.TAX_GROUPS, "tax_group string, life_years int, straight_bp int, declining_bp int")


def assets(b):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(g[0]) for g in reg.TAX_GROUPS])
    return b.read("part").select(
        k.alias("asset_id"), F.element_at(names, F.col("p_size") % 6 + 1).alias("tax_group"), F.when(k % 2 == 0, "DECLINING").otherwise("STRAIGHT").alias("method"),
        F.add_months(F.to_date(F.lit("1995-01-15")), (k % 40).cast("int")).alias("acquired_on"), F.round(F.col("p_retailprice") * 100_000).cast("long").alias("cost"),
    )


@register(
    "a39_asset_register",
    FISCAL
    + """ select a.asset_id, a.cost, coalesce(t, 0)::bigint as this_year, coalesce(c, 0)::bigint as accumulated, (a.cost - coalesce(c, 0))::bigint as book_value
    from a left join (select asset_id, sum(annual) filter (year - 1 = 1997) as t, sum(annual) as c from y where months > 0 and year - 1 <= 1997 group by 1) s using (asset_id) where year(acquired_on) <= 1997""",
)
def a39(b):
    return reg.asset_register(assets(b), reg.fiscal_years(assets(b), groups(b)), 1997)


@register(
    "a38_asset_candidates",
    with_views("journal", "select entity_id, entry_id, sum(debit - credit)::bigint as amount from journal where account = '1200' group by all having sum(debit - credit) >= 20000000 and not entry_id in (select entry_id from journal where account = '2100' and credit > 18000000)"),
)
def a38(b):
    lines = b.journal_line()
    return reg.asset_candidates(lines, "1200", lines.filter("account = '2100' and credit > 18000000"), 20_000_000)


@register(
    "a37_accrual_candidates",
    with_views(
        "journal",
        """select entity_id, account, ((s * 2 + 3) // 6)::bigint as accrue from (
        select entity_id, account, count(distinct month) filter (month < 23978) as n, count(*) filter (month = 23978) as now, sum(debit - credit) filter (month < 23978) as s
        from journal where account in ('5100', '6100', '6200', '7100', '8100') and month between 23975 and 23978 and entity_id % 6 + (month = 23978)::int < 6 group by all) where n = 3 and now = 0 and s > 0""",
    ),
)
def a37(b):
    lines = b.journal_line().filter("not (entity_id % 6 = 5 and month = 23978)")
    return reg.accrual_candidates(lines, b.chart(), "1998-03-01")


@register(
    "a35_cost_of_sales",
    with_views(
        "journal",
        """select entity_id, o as opening, p as purchases, c as closing, o + p - c as cost_of_sales from (
        select entity_id, coalesce(sum(debit - credit) filter (day < date '1998-01-01'), 0)::bigint as o, coalesce(sum(debit) filter (day >= date '1998-01-01'), 0)::bigint as p, sum(debit - credit)::bigint as c
        from journal where account = '1200' and day <= date '1998-12-31' group by 1)""",
    ),
)
def a35(b):
    return reg.cost_of_sales(b.journal_line(), "1998-01-01", "1998-12-31")


@register("m19_lease_schedules")
def m19(b):
    k = F.col("p_partkey")
    terms = b.read("part").select(
        k.alias("lease_id"), m.cents("p_retailprice").alias("payment"), F.lit(36).alias("months"), F.element_at(F.array(*map(F.lit, (1, 3, 6, 12))), (k % 4 + 1).cast("int")).alias("interval_months"),
        (k % 2 == 0).alias("advance"), (600 + k % 7 * 50).cast("int").alias("rate_bp"),
    )
    return reg.lease_schedules(terms)


@register("m6_split_vat", "select o_orderkey as order_id, g, b, g - b as t, (b * 22 + 100) // 200 as again from (select o_orderkey, g, (sign(g)::int * ((abs(g) * 100 + 55) // 111))::bigint as b from (select o_orderkey, round(o_totalprice * 100)::bigint * case when o_orderkey % 3 = 0 then -1 else 1 end as g from orders))")
def m6(b):
    gross = F.col("total") * F.when(F.col("order_id") % 3 == 0, -1).otherwise(1)
    base, vat = m.split_vat("g")
    return b.order().select("order_id", gross.alias("g")).withColumn("b", base).withColumn("t", vat).withColumn("again", m.vat_on("b"))


@register("m10_withholding", "select o_orderkey as order_id, (t * 200 * 2 + 10000) // 20000 as on_base, (t * 200 * 2 + 10900) // (2 * 10900) as from_net from (select o_orderkey, round(o_totalprice * 100)::bigint as t from orders)")
def m10(b):
    return b.order().select("order_id", m.withholding("total", 200).alias("on_base"), m.withheld_from_net("total", 200, 11).alias("from_net"))


@register(
    "m7_convert_minor",
    "select o_orderkey as order_id, ((t::hugeint * 148505 * 2 + 1000) // 2000)::bigint as to_idr, ((t::hugeint * 13456 * 100 * 2 + 1000000) // 2000000)::bigint as to_sgd from (select o_orderkey, round(o_totalprice * 100)::bigint as t from orders)",
)
def m7(b):
    return b.order().select("order_id", m.convert_minor("total", F.lit(1485050), F.lit(2), F.lit("USD"), F.lit("IDR")).alias("to_idr"), m.convert_minor("total", F.lit(13456), F.lit(4), F.lit("USD"), F.lit("SGD")).alias("to_sgd"))


@register(
    "m1_parsed_amounts",
    """select o_orderkey as order_id, ((t + 50) // 100 * case when o_orderkey % 3 = 0 then -1 else 1 end)::bigint as rupiah, t * case when o_orderkey % 3 = 0 then -1 else 1 end as cents
    from (select o_orderkey, round(o_totalprice * 100)::bigint as t from orders)""",
)
def m1(b):
    plain = F.format_number(F.col("total") / 100, 2)
    text = F.when(F.col("order_id") % 2 == 0, F.translate(plain, ",.", ".,")).otherwise(plain)
    text = F.when(F.col("order_id") % 3 == 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(F.concat(F.lit("Rp "), text))
    return b.order().select("order_id", m.parse_rupiah(text).alias("rupiah"), m.parse_cents(text).alias("cents"))


@register(
    "d2_fiscal_years",
    """select distinct day, make_date(case when month(day) > 3 then year(day) else year(day) - 1 end, 4, 1) as start, ((month(day) + 8) % 12 + 1)::int as into_year, last_day(day + interval 1 month) as vat_due,
       make_date(year(day + interval 1 month), month(day + interval 1 month), 15) as other_due from (select o_orderdate::date as day from orders)""",
)
def d2(b):
    i = d.month_index("day")
    rows = b.order().select("day").distinct()
    return rows.select("day", d.fiscal_year_start("day", 3).alias("start"), d.months_into_year("day", 3).alias("into_year"), d.due_of_month(i, True).alias("vat_due"), d.due_of_month(i, False).alias("other_due"))


@register("d4_parsed_dates", "select o_orderkey as order_id, o_orderdate::date as day from orders")
def d4(b):
    day = F.col("day")
    forms = [F.date_format(day, x) for x in ("dd/MM/yyyy", "yyyy-MM-dd", "d MMM yyyy", "dd-MM-yy")]
    text = F.element_at(F.array(*forms), (F.col("order_id") % 3 + 1).cast("int"))
    return b.order().select("order_id", d.parse_date(text).alias("day"))


@register("w1_row_numbers", with_views("ord", "select contact_id, order_id, sum(total) over (partition by contact_id order by day, order_id)::bigint as running from ord"))
def w1(b):
    w = Window.partitionBy("contact_id").orderBy("day", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    return b.order().select("contact_id", "order_id", F.sum("total").over(w).alias("running"))
