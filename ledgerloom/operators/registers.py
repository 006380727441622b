"""Assets, schedules and leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_end, month_index
from ..functions.money import half_up, split_equally
from .ledger import date, total

# Life in years, straight-line and declining rates in basis points by tax group.
TAX_GROUPS = [("GROUP_1", 4, 2500, 5000), ("GROUP_2", 8, 1250, 2500), ("GROUP_3", 16, 625, 1250), ("GROUP_4", 20, 500, 1000), ("BUILDING", 20, 500, None), ("LIGHT_BUILDING", 10, 1000, None)]


def installments(schedules: DataFrame) -> DataFrame:
    """Equal parts by month, the last with the remainder; a reversing schedule adds one part back."""
    n = F.col("months")
    rows = schedules.withColumn("k", F.explode(F.sequence(F.lit(1), n + F.col("reverse").cast("int"))))
    back = F.col("k") > n
    m = F.col("start_month") + F.col("k") - 1
    amount = F.when(back, F.col("amount")).otherwise(split_equally("amount", n, "k"))
    day = F.when(back, F.trunc(month_end(m), "MM")).otherwise(month_end(m))
    return rows.select("schedule_id", "k", day.alias("day"), amount.cast("long").alias("amount"), back.alias("reversal"))


def fiscal_years(assets: DataFrame, groups: DataFrame) -> DataFrame:
    """Tax depreciation by year: asset_id, year, months, annual, book_value behind it.

    The yearly chain of a declining balance is folded over the years of an asset's life, at most 21."""
    # a register is small and its folds are not: dealt by asset, as what follows sums and orders by it
    a = assets.repartition("asset_id").join(F.broadcast(groups), "tax_group").withColumn("_first", month_index("acquired_on"))
    a = a.withColumn("_last", F.col("_first") + F.col("life_years") * 12 - 1)
    declining = (F.col("method") == "DECLINING") & F.col("declining_bp").isNotNull()
    a = a.withColumn("_bp", F.when(declining, F.col("declining_bp")).otherwise(F.col("straight_bp")))
    years = F.sequence(F.floor(F.col("_first") / 12).cast("int"), F.floor(F.col("_last") / 12).cast("int"))

    def step(acc, year):
        start, stop = F.greatest(F.col("_first"), year * 12), F.least(F.col("_last"), year * 12 + 11)
        months = stop - start + 1
        left = acc["left"]
        base = F.when(declining, left).otherwise(F.col("cost"))
        share = half_up(base.cast("decimal(18,0)") * F.col("_bp") * months, 120_000)
        annual = F.when(stop == F.col("_last"), left).otherwise(share)
        row = F.struct(year.alias("year"), months.cast("int").alias("months"), annual.alias("annual"), (left - annual).alias("book_value"))
        return F.struct((left - annual).alias("left"), F.array_append(acc["rows"], row).alias("rows"))

    empty = F.from_json(F.lit("[]"), "array<struct<year:int,months:int,annual:bigint,book_value:bigint>>")
    folded = F.aggregate(years, F.struct(F.col("cost").alias("left"), empty.alias("rows")), step, lambda acc: acc["rows"])
    return a.select("asset_id", F.inline(folded))


def asset_register(assets: DataFrame, years: DataFrame, year: int) -> DataFrame:
    """Cost, the year's depreciation, accumulated depreciation and book value at the year's end."""
    sums = years.filter(F.col("year") <= year).groupBy("asset_id").agg(total(F.when(F.col("year") == year, F.col("annual"))).alias("this_year"), total("annual").alias("accumulated"))
    rows = assets.filter(F.year("acquired_on") <= year).join(sums, "asset_id", "left").fillna(0, ["this_year", "accumulated"])
    return rows.select("asset_id", "cost", "this_year", "accumulated", (F.col("cost") - F.col("accumulated")).alias("book_value"))


def asset_candidates(lines: DataFrame, account: str, cited: DataFrame, least: int) -> DataFrame:
    """Entries with a net debit on an asset account of at least ``least`` that no asset cites."""
    rows = lines.filter(F.col("account") == account).groupBy("entity_id", "entry_id").agg(total(F.col("debit") - F.col("credit")).alias("amount"))
    return rows.filter(F.col("amount") >= least).join(cited.select("entry_id"), "entry_id", "left_anti")


def accrual_candidates(lines: DataFrame, chart: DataFrame, month: str) -> DataFrame:
    """Expense accounts of an entity that moved in each of the three months before and not in this
    one, with the mean to accrue."""
    m = month_index(date(month))
    rows = lines.filter(F.col("month").between(m - 3, m)).join(F.broadcast(chart.filter("type = 'EXPENSE'").select("account")), "account")
    sums = rows.groupBy("entity_id", "account").agg(
        F.count_distinct(F.when(F.col("month") < m, F.col("month"))).alias("n"), F.count_if(F.col("month") == m).alias("now"), total(F.when(F.col("month") < m, F.col("debit") - F.col("credit"))).alias("sum")
    )
    return sums.filter("n = 3 and now = 0 and sum > 0").select("entity_id", "account", half_up("sum", 3).alias("accrue"))


LEASE = "lease_id long, k int, opening long, payment long, interest long, closing long, depreciation long"


def lease_schedule(payment: int, months: int, interval: int, advance: bool, rate_bp: int) -> list[tuple[int, ...]]:
    """By month opening, payment, interest, closing and depreciation of a lease.

    The liability is an exact fraction; each month end is rounded once, half away from zero."""
    one, grown = 120_000, 120_000 + rate_bp

    def rounded(n: int, d: int) -> int:
        return (2 * n + d) // (2 * d) if n >= 0 else -((-2 * n + d) // (2 * d))

    times = [j * interval + (0 if advance else interval) for j in range(months // interval)]
    last = max(times)
    num, den = payment * sum(one**t * grown ** (last - t) for t in times), grown**last
    start = left = rounded(num, den)
    each, out = start // months, []
    for k in range(1, months + 1):
        early, late = advance and (k - 1) % interval == 0, not advance and k % interval == 0
        num = (num - payment * den * early) * grown
        den *= one
        num -= payment * den * late
        closing, paid = rounded(num, den), payment * (early or late)
        out.append((k, left, paid, closing - left + paid, closing, start - each * (months - 1) if k == months else each))
        left = closing
    return out


def lease_schedules(leases: DataFrame) -> DataFrame:
    """``lease_schedule`` of every lease (lease_id, payment, months, interval_months, advance, rate_bp)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in LEASE.split(", ")]
        for pdf in batches:
            rows = [(r.lease_id, *row) for r in pdf.itertuples() for row in lease_schedule(int(r.payment), int(r.months), int(r.interval_months), bool(r.advance), int(r.rate_bp))]
            yield pd.DataFrame(rows, columns=names)

    return leases.select("lease_id", "payment", "months", "interval_months", "advance", "rate_bp").mapInPandas(run, LEASE)


def cost_of_sales(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Opening stock, what came in, closing stock and what they leave as cost of sales, by entity."""
    stock = lines.filter((F.col("account") == "1200") & (F.col("day") <= date(end)))
    inside = F.col("day") >= date(start)
    rows = stock.groupBy("entity_id").agg(total(F.when(~inside, F.col("debit") - F.col("credit"))).alias("opening"), total(F.when(inside, F.col("debit"))).alias("purchases"), total(F.col("debit") - F.col("credit")).alias("closing"))
    return rows.withColumn("cost_of_sales", F.col("opening") + F.col("purchases") - F.col("closing"))
