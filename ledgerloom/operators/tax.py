"""Tax computations in whole currency units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import due_of_month, month_index, tax_month
from ..functions.money import corporate_tax, div, progressive_tax, to_thousands
from .ledger import date, total

# The allowance of a year by marital status and dependents.
ALLOWANCES = {"TK0": 54_000_000, "TK1": 58_500_000, "TK2": 63_000_000, "TK3": 67_500_000, "K0": 58_500_000, "K1": 63_000_000, "K2": 67_500_000, "K3": 72_000_000}


def corporate(rows: DataFrame, months: int = 12) -> DataFrame:
    """Taxable (down to thousands), tax due, instalments, balance and the next instalment."""
    rows = rows.withColumn("taxable", to_thousands("profit"))
    rows = rows.withColumn("due", corporate_tax("taxable", "turnover", months)).withColumn("balance", F.col("due") - F.col("withheld") - F.col("instalments"))
    return rows.withColumn("next_instalment", F.greatest(F.lit(0), div(F.col("due") - F.col("withheld"), months))).withColumn("deferred", div(F.col("difference") * 22, 100))


def monthly_wage_tax(wages: DataFrame, brackets: DataFrame) -> DataFrame:
    """Tax of a month from the bracket table (category, upper, rate_bp; upper null for the last):
    the rate of the first bracket whose upper end isn't below the wage, rounded down."""
    rows = wages.join(F.broadcast(brackets), "category").filter(F.col("upper").isNull() | (F.col("wage") <= F.col("upper")))
    picked = rows.groupBy("employee_id", "category", "wage").agg(F.min_by("rate_bp", F.coalesce("upper", F.lit(9 * 10**18))).alias("rate_bp"))
    return picked.withColumn("tax", F.when(F.col("wage") > 0, div(F.col("wage") * F.col("rate_bp"), 10_000)).otherwise(0))


def annual_wage_tax(wages: DataFrame, months: int = 12) -> DataFrame:
    """The year's tax by layers after the occupational deduction and the allowance, and
    December's: that less what the other months have withheld (``tax`` of a month)."""
    allowance = F.create_map(*[F.lit(x) for kv in ALLOWANCES.items() for x in kv])[F.col("status")]
    gross = F.greatest(F.col("wage"), F.lit(0)) * months
    rows = wages.withColumn("gross", gross.cast("long"))
    net = F.col("gross") - F.least(div(F.col("gross") * 5, 100), F.lit(500_000 * months))
    rows = rows.withColumn("taxable", to_thousands(net - allowance)).withColumn("annual", progressive_tax("taxable"))
    return rows.withColumn("december", F.col("annual") - F.col("tax") * (months - 1))


def loss_use(losses: DataFrame, profits: DataFrame, year: int) -> DataFrame:
    """Losses of the five years before, oldest first, against the year's profit."""
    rows = losses.join(profits, "entity_id").withColumn("expired", (F.col("origin_year") + 5 < year) | (F.col("origin_year") >= year))
    usable = F.when(F.col("expired"), 0).otherwise(F.col("amount"))
    before = F.coalesce(F.sum(usable).over(Window.partitionBy("entity_id").orderBy("origin_year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = F.greatest(F.lit(0), F.least(usable, F.greatest("profit", F.lit(0)) - before))
    return rows.select("entity_id", "origin_year", "amount", "expired", used.cast("long").alias("used"), (F.col("amount") - used).cast("long").alias("remaining"))


def vat_carry(months: DataFrame) -> DataFrame:
    """VAT by month in a year, where an overpayment carries to the next month.

    With n = output less input and S the running sum of -n, the carry is S less the least of 0 and S's
    running minimum."""
    w = Window.partitionBy("entity_id", "year").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = months.withColumn("_s", F.sum(F.col("input") - F.col("output")).over(w))
    rows = rows.withColumn("carry", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    before = F.coalesce(F.lag("carry").over(Window.partitionBy("entity_id", "year").orderBy("month")), F.lit(0))
    net = F.col("output") - F.col("input") - before
    return rows.select("entity_id", "year", "month", "output", "input", net.cast("long").alias("net"), F.col("carry").cast("long").alias("carry"))


def late_payments(owed: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments of a month in date order: what fills the month's shortfall and what is paid ahead."""
    rows = payments.join(owed, ["entity_id", "month"])
    before = F.coalesce(F.sum("amount").over(Window.partitionBy("entity_id", "month").orderBy("day", "payment_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("amount"), F.col("owed") - before))
    return rows.select("entity_id", "month", "payment_id", "day", "amount", take.cast("long").alias("late"), (F.col("amount") - take).cast("long").alias("ahead"))


def monthly_report(lines: DataFrame, account: str, month: str) -> DataFrame:
    """By entity what a tax account owes for a month, its due date, what is paid until then, and the state."""
    m = month_index(date(month))
    due = due_of_month(m, vat=True)
    own = lines.filter(F.col("account") == account)
    owed = own.filter(F.col("month") == m).groupBy("entity_id").agg(total("credit").alias("owed"))
    paid = own.filter((F.last_day(date(month)) < F.col("day")) & (F.col("day") <= due)).groupBy("entity_id").agg(total("debit").alias("paid"))
    rows = owed.join(paid, "entity_id", "left").fillna(0, ["paid"]).withColumn("due_on", due)
    state = F.when((F.col("owed") == 0) & (F.col("paid") == 0), "NIL").when(F.col("paid") > F.col("owed"), "OVER").when(F.col("paid") == F.col("owed"), "PAID").otherwise("SHORT")
    return rows.withColumn("state", state)


def payments_by_tax_month(payments: DataFrame) -> DataFrame:
    """Instalments by the month they are for, by default the one before the payment."""
    for_month = F.coalesce("tax_month", tax_month("day"))
    return payments.groupBy("entity_id", for_month.alias("for_month")).agg(total("amount").alias("amount"), F.count("*").alias("n"))


def target_differences(target: DataFrame, posted: DataFrame) -> DataFrame:
    """Target less posted by key, where they differ."""
    rows = target.join(posted, ["entity_id", "account"], "full_outer").fillna(0, ["target", "posted"])
    return rows.withColumn("difference", F.col("target") - F.col("posted")).filter("difference <> 0")
