"""Balances and statements from journal lines; ``net`` is debit less credit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import fiscal_year_start, month_index, month_start
from ..functions.money import div, percent_one_decimal

KEYS = ["client_id", "entity_id", "account"]
BALANCE_TYPES = ["ASSET", "LIABILITY", "EQUITY"]
#: Statement lines that an account of a type may be on.
LINES = {
    "ASSET": ["CASH", "RECEIVABLES", "INTERCOMPANY", "INVENTORY", "FIXED_ASSETS"],
    "LIABILITY": ["PAYABLES", "TAX_PAYABLE"],
    "EQUITY": ["CAPITAL", "RETAINED", "TRANSLATION"],
    "INCOME": ["REVENUE", "OTHER_INCOME"],
    "EXPENSE": ["COGS", "SELLING", "ADMIN", "OTHER_EXPENSE", "TAX"],
}


def date(text: str):
    return F.to_date(F.lit(text))


def total(x):
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def net():
    return F.col("debit") - F.col("credit")


def gl_month(lines: DataFrame) -> DataFrame:
    """Debit and credit by entity, account, month and kind of entry: the aggregate that reports start from."""
    return lines.groupBy(*KEYS, "month", "entry_kind").agg(total("debit").alias("debit"), total("credit").alias("credit"), F.count("*").alias("n_lines"))


def sum_by_account(lines: DataFrame, start: str | None, end: str, by_entity: bool = False) -> DataFrame:
    """A1: debit and credit by account over a range of dates, both ends included."""
    if start:
        lines = lines.filter(F.col("day") >= date(start))
    lines = lines.filter(F.col("day") <= date(end))
    return lines.groupBy("client_id", *(["entity_id"] if by_entity else []), "account").agg(total("debit").alias("debit"), total("credit").alias("credit"))


def trial_balance(lines: DataFrame, chart: DataFrame, as_of: str, by: tuple[str, ...] = ("client_id",), fiscal_end: int = 12) -> DataFrame:
    """A row for each account of the chart; income and expense count from the start of the
    financial year, what they were before is in retained earnings, so the nets add up to zero."""
    start = fiscal_year_start(date(as_of), fiscal_end)
    lines = lines.filter(F.col("day") <= date(as_of)).join(F.broadcast(chart.select("account", "type")), "account")
    earlier = ~F.col("type").isin(BALANCE_TYPES) & (F.col("day") < start)
    sums = lines.groupBy(*by, F.when(earlier, "3200").otherwise(F.col("account")).alias("account")).agg(total(net()).alias("net"))
    scopes = sums.select(*by).distinct()
    full = scopes.crossJoin(F.broadcast(chart.select("account", "account_name", "type", "fs_line", "kind")))  # the chart is a fixed list
    rows = full.join(sums, [*by, "account"], "left").withColumn("net", F.coalesce("net", F.lit(0)).cast("long"))
    return rows.withColumn("debit", F.greatest("net", F.lit(0))).withColumn("credit", F.greatest(-F.col("net"), F.lit(0)))


def trial_balance_movement(lines: DataFrame, chart: DataFrame, start: str, end: str) -> DataFrame:
    """Opening is closing less the period's movement."""
    closing = trial_balance(lines, chart, end).select("client_id", "account", "net")
    moves = sum_by_account(lines, start, end).withColumnRenamed("debit", "period_debit").withColumnRenamed("credit", "period_credit")
    rows = closing.join(moves, ["client_id", "account"], "left").fillna(0, ["period_debit", "period_credit"])
    return rows.withColumn("opening", F.col("net") - F.col("period_debit") + F.col("period_credit"))


def by_contact(lines: DataFrame, account: str, as_of: str) -> DataFrame:
    """A5: what is behind an account, by contact; zero nets go."""
    rows = lines.filter((F.col("account") == account) & (F.col("day") <= date(as_of)))
    return rows.groupBy("client_id", "contact_id").agg(total("debit").alias("debit"), total("credit").alias("credit")).filter("debit <> credit")


def unmapped(chart: DataFrame) -> DataFrame:
    """Accounts whose statement line isn't one of their type."""
    allowed = chart.sparkSession.createDataFrame([(t, x) for t, xs in LINES.items() for x in xs], "type string, fs_line string")
    return chart.join(F.broadcast(allowed), ["type", "fs_line"], "left_anti").select("account", "type", "fs_line")


def income_lines(lines: DataFrame, chart: DataFrame, start: str, end: str) -> DataFrame:
    """Signed amounts by statement line: income and expenses positive, other expenses negated;
    accounts on a line that isn't theirs are on a line of their own."""
    rows = sum_by_account(lines, start, end).join(F.broadcast(chart), "account").filter("type in ('INCOME', 'EXPENSE')")
    fits = F.lit(False)
    for t in ("INCOME", "EXPENSE"):
        fits = fits | ((F.col("type") == t) & F.col("fs_line").isin(LINES[t]))
    line = F.when(fits, F.col("fs_line")).otherwise(F.concat(F.lit("UNMAPPED_"), F.col("type")))
    amount = F.when((F.col("type") == "INCOME") | line.isin("OTHER_EXPENSE", "UNMAPPED_EXPENSE"), -net()).otherwise(net())
    return rows.groupBy("client_id", line.alias("line")).agg(total(amount).alias("amount"), F.count("*").alias("n_accounts")).filter("amount <> 0")


def income_totals(lines: DataFrame, chart: DataFrame, start: str, end: str) -> DataFrame:
    """Gross, operating, before-tax and net profit."""
    rows = income_lines(lines, chart, start, end)
    of = lambda *names: total(F.when(F.col("line").isin(*names), F.col("amount")))
    sums = rows.groupBy("client_id").agg(
        of("REVENUE").alias("revenue"), of("COGS").alias("_cogs"), of("SELLING", "ADMIN").alias("_opex"),
        of("OTHER_INCOME", "OTHER_EXPENSE", "UNMAPPED_INCOME", "UNMAPPED_EXPENSE").alias("_other"), of("TAX").alias("_tax"),
    )
    gross = F.col("revenue") - F.col("_cogs")
    before = gross - F.col("_opex") + F.col("_other")
    return sums.select("client_id", "revenue", gross.alias("gross_profit"), (gross - F.col("_opex")).alias("operating_profit"), before.alias("profit_before_tax"), (before - F.col("_tax")).alias("net_profit"))


def balance_sheet(lines: DataFrame, chart: DataFrame, as_of: str, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """By section and line; an intercompany credit balance is a liability, the current year's
    profit a line of equity."""
    tb = trial_balance(lines, chart, as_of, by)
    credit = (F.col("kind") == "INTERCOMPANY") & (F.col("net") < 0)
    profit = ~F.col("type").isin(BALANCE_TYPES)
    section = F.when(credit, "LIABILITY").when(profit, "EQUITY").otherwise(F.col("type"))
    line = F.when(credit, "INTERCOMPANY_PAYABLE").when(profit, "CURRENT_PROFIT").otherwise(F.col("fs_line"))
    amount = F.when(section == "ASSET", F.col("net")).otherwise(-F.col("net"))
    rows = tb.groupBy(*by, section.alias("section"), line.alias("line")).agg(total(amount).alias("amount"))
    return rows.filter("amount <> 0 or line = 'CURRENT_PROFIT'")


def balance_check(lines: DataFrame, chart: DataFrame, as_of: str) -> DataFrame:
    """Assets less liabilities less equity, by entity."""
    rows = balance_sheet(lines, chart, as_of, ("client_id", "entity_id"))
    of = lambda s: total(F.when(F.col("section") == s, F.col("amount")))
    sums = rows.groupBy("client_id", "entity_id").agg(of("ASSET").alias("assets"), of("LIABILITY").alias("liabilities"), of("EQUITY").alias("equity"))
    return sums.withColumn("difference", F.col("assets") - F.col("liabilities") - F.col("equity"))


def combined_worksheet(lines: DataFrame, chart: DataFrame, as_of: str) -> DataFrame:
    """A client's trial balances with the intercompany account as receivable and payable rows,
    of which the smaller is eliminated from both. In long form: entities of a client are its rows."""
    tb = trial_balance(lines, chart, as_of, ("client_id", "entity_id"))
    plain = tb.filter("kind <> 'INTERCOMPANY'").groupBy("client_id", "account").agg(total("net").alias("total"), F.max(F.abs("net")).alias("_most"))
    plain = plain.filter("_most > 0").select("client_id", "account", F.lit("ALL").alias("part"), "total", F.lit(0).cast("long").alias("elimination"), F.col("total").alias("combined"))
    inter = tb.filter("kind = 'INTERCOMPANY'").groupBy("client_id", "account").agg(total("debit").alias("p"), total("credit").alias("u")).withColumn("m", F.least("p", "u"))
    recv = inter.select("client_id", "account", F.lit("RECEIVABLE").alias("part"), F.col("p").alias("total"), (-F.col("m")).alias("elimination"), (F.col("p") - F.col("m")).alias("combined"))
    pay = inter.select("client_id", "account", F.lit("PAYABLE").alias("part"), (-F.col("u")).alias("total"), F.col("m").alias("elimination"), (F.col("m") - F.col("u")).alias("combined"))
    return plain.unionByName(recv).unionByName(pay)


def month_series(lines: DataFrame, chart: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Cash at each month's end and the month's revenue and expense, over the last months."""
    last = month_index(date(as_of))
    base = gl_month(lines.filter(F.col("day") <= date(as_of))).join(F.broadcast(chart.select("account", "type", "fs_line")), "account")
    moves = base.groupBy("client_id", F.greatest("month", last - months).alias("month")).agg(
        total(F.when(F.col("fs_line") == "CASH", net())).alias("_cash"),
        total(F.when(F.col("type") == "INCOME", -net())).alias("revenue"),
        total(F.when(F.col("type") == "EXPENSE", net())).alias("expense"),
    )
    calendar = moves.select("client_id").distinct().withColumn("month", F.explode(F.sequence(last - months, last)))
    rows = calendar.join(moves, ["client_id", "month"], "left").fillna(0)
    running = Window.partitionBy("client_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cash", F.sum("_cash").over(running)).filter(F.col("month") > last - months)
    return rows.select("client_id", F.year(month_start("month")).alias("year"), F.month(month_start("month")).alias("month"), "cash", "revenue", "expense")


def equity_changes(lines: DataFrame, chart: DataFrame, start: str, end: str) -> DataFrame:
    """Opening, movement and profit by line of equity, and closing."""
    before = lines.filter(F.col("day") < date(start))
    opening = trial_balance(before, chart, f"{int(start[:4]) - 1}-12-31").filter("type = 'EQUITY'")
    opening = opening.groupBy("client_id", "fs_line").agg(total(-F.col("net")).alias("amount")).withColumn("row", F.lit("OPENING"))
    year_before = trial_balance(before, chart, f"{int(start[:4]) - 1}-12-31").filter("type in ('INCOME', 'EXPENSE')")
    carried = year_before.groupBy("client_id").agg(total(-F.col("net")).alias("amount")).select("client_id", F.lit("RETAINED").alias("fs_line"), "amount", F.lit("OPENING").alias("row"))
    during = lines.filter(F.col("day").between(date(start), date(end))).join(F.broadcast(chart.select("account", "type", "fs_line")), "account")
    moved = during.filter("type = 'EQUITY'").groupBy("client_id", "fs_line").agg(total(-net()).alias("amount")).withColumn("row", F.lit("MOVEMENT"))
    profit = during.filter("type in ('INCOME', 'EXPENSE')").groupBy("client_id").agg(total(-net()).alias("amount"))
    profit = profit.select("client_id", F.lit("RETAINED").alias("fs_line"), "amount", F.lit("PROFIT").alias("row"))
    rows = opening.unionByName(carried).unionByName(moved).unionByName(profit)
    rows = rows.unionByName(rows.withColumn("row", F.lit("CLOSING")))
    return rows.groupBy("client_id", "row", "fs_line").agg(total("amount").alias("amount")).filter("amount <> 0")


def asset_movement(lines: DataFrame, chart: DataFrame, fs_line: str, start: str, end: str) -> DataFrame:
    """Opening, additions, deductions and closing by account of a line."""
    rows = lines.filter(F.col("day") <= date(end)).join(F.broadcast(chart.filter(F.col("fs_line") == fs_line).select("account")), "account")
    inside = F.col("day") >= date(start)
    sums = rows.groupBy("client_id", "account").agg(
        total(F.when(~inside, net())).alias("opening"), total(F.when(inside, F.col("debit"))).alias("additions"), total(F.when(inside, F.col("credit"))).alias("deductions")
    )
    return sums.withColumn("closing", F.col("opening") + F.col("additions") - F.col("deductions"))


def indirect_cash_flow(lines: DataFrame, chart: DataFrame, start: str, end: str) -> DataFrame:
    """Profit and the turned-round change of every balance account but cash, by section."""
    rows = lines.filter(F.col("day").between(date(start), date(end))).join(F.broadcast(chart.select("account", "type", "fs_line")), "account")
    section = (
        F.when(F.col("fs_line") == "CASH", "CASH")
        .when(F.col("fs_line") == "FIXED_ASSETS", "INVESTING")
        .when((F.col("type") == "EQUITY") | (F.col("fs_line") == "INTERCOMPANY"), "FINANCING")
        .otherwise("OPERATING")
    )
    line = F.when(~F.col("type").isin(BALANCE_TYPES), "PROFIT").otherwise(F.col("fs_line"))
    amount = F.when(section == "CASH", net()).otherwise(-net())
    return rows.groupBy("client_id", section.alias("section"), line.alias("line")).agg(total(amount).alias("amount"))


def account_ledger(lines: DataFrame, account: str, start: str, end: str) -> DataFrame:
    """An account's entries by entity with a running balance from the opening one."""
    rows = lines.filter((F.col("account") == account) & (F.col("day") <= date(end)))
    opening = rows.filter(F.col("day") < date(start)).groupBy("entity_id").agg(total(net()).alias("opening"))
    entries = rows.filter(F.col("day") >= date(start)).groupBy("entity_id", "day", "entry_id").agg(total("debit").alias("debit"), total("credit").alias("credit"))
    running = Window.partitionBy("entity_id").orderBy("day", "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    return entries.join(opening, "entity_id", "left").select(
        "entity_id", "day", "entry_id", "debit", "credit", (F.coalesce("opening", F.lit(0)) + F.sum(net()).over(running)).cast("long").alias("balance")
    )


def tax_month_summary(lines: DataFrame, month: str) -> DataFrame:
    """Debit and credit of the tax accounts in a month."""
    rows = lines.filter((F.col("month") == month_index(date(month))) & F.col("account").isin("2130", "8100"))
    return rows.groupBy("client_id", "account").agg(total("debit").alias("debit"), total("credit").alias("credit"))


def origins(lines: DataFrame, end: str) -> DataFrame:
    """Lines by origin of their entry."""
    kinds = ("BANK", "INVOICE", "MANUAL")
    rows = lines.filter(F.col("day") <= date(end)).groupBy("client_id", "account")
    return rows.agg(*[F.count_if(F.col("entry_kind") == k).alias(f"n_{k.lower()}") for k in kinds], F.count_if(~F.col("entry_kind").isin(*kinds)).alias("n_other"))


def management(lines: DataFrame, chart: DataFrame, month: str) -> DataFrame:
    """Revenue and net profit of a month, the one before and the year to date."""
    m = month_index(date(month))
    base = gl_month(lines).join(F.broadcast(chart.select("account", "type")), "account").filter("type in ('INCOME', 'EXPENSE')")
    year = F.col("month").between(m - F.month(date(month)) + 1, m)
    sums = base.groupBy("client_id").agg(
        *[total(F.when(when & cond, -net())).alias(f"{name}_{what}") for name, when in (("month", F.col("month") == m), ("previous", F.col("month") == m - 1), ("year", year)) for what, cond in (("revenue", F.col("type") == "INCOME"), ("profit", F.lit(True)))]
    )
    return sums.withColumn("month_margin", percent_one_decimal("month_profit", "month_revenue")).withColumn("year_margin", percent_one_decimal("year_profit", "year_revenue"))


def report_format(lines: DataFrame, chart: DataFrame, layout: DataFrame, start: str, end: str) -> DataFrame:
    """A report as data: ``layout`` (row_no, line, sign) lists the statement lines that each row
    adds up; amounts are shown in thousands, rounded half away from zero."""
    amounts = income_lines(lines, chart, start, end)
    rows = F.broadcast(layout).join(amounts, "line").groupBy("client_id", "row_no").agg(total(F.col("amount") * F.col("sign")).alias("amount"))
    return rows.withColumn("thousands", F.signum("amount").cast("int") * div(F.abs("amount") * 2 + 1000, 2000))


def flux(lines: DataFrame, chart: DataFrame, month: str, baseline: int = 3) -> DataFrame:
    """Movements of a month against the mean of the months before: large changes, movements
    against an account's nature, and accounts that rest after having moved each month.

    Changes are kept times the number of baseline months, so that nothing is rounded; material is one
    percent of the baseline's mean monthly volume of income and expense."""
    m = month_index(date(month))
    base = gl_month(lines.filter("entry_kind <> 'OPENING'")).filter(F.col("month").between(m - baseline, m))
    base = base.join(F.broadcast(chart.select("account", "type")), "account")
    natural = F.when(F.col("type").isin("ASSET", "EXPENSE"), net()).otherwise(-net())
    now = F.col("month") == m
    rows = base.groupBy("client_id", "account", "type").agg(
        total(F.when(now, natural)).alias("current"), total(F.when(~now, natural)).alias("before"), F.count_distinct(F.when(~now, F.col("month"))).alias("n_before"), F.count_if(now).alias("_now")
    )
    volume = base.filter((F.col("month") < m) & F.col("type").isin("INCOME", "EXPENSE")).groupBy("client_id").agg(total(F.abs(natural)).alias("volume"))
    rows = rows.join(volume, "client_id", "left").fillna(0, ["volume"])
    change = F.col("current") * F.lit(baseline) - F.col("before")
    kind = (
        F.when((F.col("_now") == 0) & (F.col("n_before") == baseline), "DORMANT")
        .when(F.col("type").isin("INCOME", "EXPENSE") & (F.col("current") < 0), "FLIP")
        .when((F.col("n_before") >= 2) & (F.abs(change) * 100 >= F.col("volume")) & (F.abs(change) * 2 >= F.abs("before")), "FLUX")
    )
    return rows.select("client_id", "account", kind.alias("finding"), "current", "before", change.alias("change_times_n")).filter("finding is not null")
