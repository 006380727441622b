"""Cleaning and proving of statement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.dates import month_index


def after(key: str, order: str) -> WindowSpec:
    """All later rows of a key, read from its end: a frame that ends at the last row is summed anew for
    each row, one that begins at the first row only grows. The next row is the last of the frame."""
    return Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)


def rejects(rows: DataFrame, cap: int = 10**15) -> DataFrame:
    """Rows that may not be imported and why."""
    reason = F.when(F.col("amount") == 0, "ZERO").when(~F.year("day").between(2000, 2100), "DATE").when(F.abs("amount") > cap, "AMOUNT")
    return rows.withColumn("reason", reason).filter("reason is not null")


def running_balances(rows: DataFrame, key: str, order: str, opening: int = 0) -> DataFrame:
    """``expected``: the sum of movements since the last printed balance, from that balance on."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_island", F.count("balance").over(before)).withColumn("_base", F.coalesce(F.last("balance", ignorenulls=True).over(before), F.lit(opening)))
    inside = Window.partitionBy(key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("expected", F.col("_base") + F.sum("amount").over(inside)).drop("_island", "_base")


def broken_balances(rows: DataFrame, key: str, order: str, opening: int = 0) -> DataFrame:
    """Rows whose printed balance isn't what the movements give."""
    return running_balances(rows, key, order, opening).filter("balance is not null and balance <> expected")


def proved_rows(rows: DataFrame, key: str, order: str, chained: bool = False) -> DataFrame:
    """Each row's state against the balance before it, and the balance ``expected`` behind it.

    ``rows``: key, order, day (null if it is no date), debit, credit, balance, and the key's opening
    balance or null. A printed balance is gone on from even if it breaks. With ``chained``, rows without
    a balance take the state of the next printed one of their day, if only such rows are between."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    debit, credit = F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))
    rows = rows.withColumn("_m", (credit - debit).cast("long")).withColumn("_island", F.count("balance").over(before)).withColumn("_base", F.coalesce(F.last("balance", ignorenulls=True).over(before), "opening"))
    inside = Window.partitionBy(key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("expected", F.col("_base") + F.sum("_m").over(inside))
    state = (
        F.when(F.col("day").isNull(), "BAD_DATE")
        .when((debit < 0) | (credit < 0) | ((debit != 0) & (credit != 0)), "BAD_AMOUNT")
        .when(F.col("_m") == 0, "NO_AMOUNT")
        .when(F.col("_base").isNull(), "NO_OPENING")
        .when(F.col("balance").isNull(), "NO_BALANCE")
        .when(F.col("balance") == F.col("expected"), "OK")
        .otherwise("BREAK")
    )
    rows = rows.withColumn("state", state)
    if chained:
        turn = F.when(F.col("day").eqNullSafe(F.lag("day").over(w)), 0).otherwise(1)
        rows = rows.withColumn("_turn", turn).withColumn("_turn", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        settled = F.when(F.col("state") != "NO_BALANCE", F.struct("state", "_turn"))
        rows = rows.withColumn("_next", F.last(settled, ignorenulls=True).over(after(key, order)))
        proves = (F.col("state") == "NO_BALANCE") & (F.col("_next._turn") == F.col("_turn")) & F.col("_next.state").isin("OK", "BREAK")
        rows = rows.withColumn("state", F.when(proves, F.col("_next.state")).otherwise(F.col("state"))).drop("_turn", "_next")
    return rows.drop("_m", "_island", "_base")


def statement_proofs(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Whether a statement may be imported: an opening, no row that isn't OK, and the closing
    balance, if there is one, printed on the last row. ``rows``: those of ``proved_rows`` with ``closing``."""
    sums = rows.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("state") != "OK").alias("_bad"), F.max_by("balance", order).alias("_last"), F.max("opening").alias("_opening"), F.max("closing").alias("_closing")
    )
    closing_ok = F.when(F.col("_closing").isNotNull(), F.col("_last").eqNullSafe(F.col("_closing")))
    problems = F.col("_bad") + F.when(closing_ok == False, 1).otherwise(0)  # noqa: E712
    return sums.select(key, "n_rows", closing_ok.alias("closing_ok"), problems.alias("problems"), (F.col("_opening").isNotNull() & (problems == 0)).alias("importable"))


def later_balances(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``confirmed``: whether a later row prints a balance."""
    return rows.withColumn("confirmed", F.coalesce(F.max(F.col("balance").isNotNull()).over(after(key, order)), F.lit(False)))


def month_ranges(rows: DataFrame, key: str) -> DataFrame:
    """Consecutive months as ranges."""
    rows = rows.distinct()
    rows = rows.withColumn("_g", F.col("month") - F.row_number().over(Window.partitionBy(key).orderBy("month")))
    return rows.groupBy(key, "_g").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("n_months")).drop("_g")


def missing_months(rows: DataFrame, key: str) -> DataFrame:
    """Months between a key's first and last that it doesn't have."""
    span = rows.groupBy(key).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    return span.select(key, F.explode(F.sequence("lo", "hi")).alias("month")).join(rows.distinct(), [key, "month"], "left_anti")


def year_typos(rows: DataFrame, key: str, row_id: str, gap: int = 6, most: int = 5) -> DataFrame:
    """Rows far from the main run of months, with the only number of years that brings
    them into it; at most ``most`` and under half of a key's rows may be far."""
    w = Window.partitionBy(key).orderBy("month", row_id)
    rows = rows.withColumn("month", month_index("day"))
    rows = rows.withColumn("_new", F.when(F.col("month") - F.lag("month").over(w) > gap, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy(key, "_run").agg(F.count("*").alias("n"), F.min("month").alias("lo"), F.max("month").alias("hi"))
    main = runs.groupBy(key).agg(F.max_by(F.struct("_run", "n", "lo", "hi"), F.struct("n", -F.col("_run"))).alias("main"), F.sum("n").alias("total"))
    far = F.col("total") - F.col("main.n")
    main = main.filter((far <= most) & (far * 2 < F.col("total")))
    rows = rows.join(main, key).filter(F.col("_run") != F.col("main._run"))
    shifts = F.array(*[F.lit(v) for v in range(-9, 10) if v])
    moves = F.filter(shifts, lambda v: (F.col("month") + v * 12).between(F.col("main.lo"), F.col("main.hi")))
    return rows.withColumn("_moves", moves).filter(F.size("_moves") == 1).select(row_id, key, "day", F.get("_moves", F.lit(0)).alias("years"))


def carried_down(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """An empty cell takes the last one above that isn't."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def yearless_dates(rows: DataFrame, key: str, order: str, year: int) -> DataFrame:
    """Days and months without a year: a fall of six months or more starts the next year."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.when(F.lag("month").over(w) - F.col("month") >= 6, 1).otherwise(0)
    rows = rows.withColumn("_step", step)
    years = F.lit(year) + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("day", F.make_date(years.cast("int"), "month", "mday")).drop("_step")


def direction_verdict(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Whether a file's amounts are from the bank's side or the book's: breaks of the printed
    balances are counted under both signs; they flip only if the bank's side breaks, the book's doesn't
    and at least two balances are printed."""
    bank = broken_balances(rows, key, order).groupBy(key).agg(F.count("*").alias("bank_breaks"))
    book = broken_balances(rows.withColumn("amount", -F.col("amount")), key, order).groupBy(key).agg(F.count("*").alias("book_breaks"))
    counts = rows.groupBy(key).agg(F.count("balance").alias("n_balances")).join(bank, key, "left").join(book, key, "left").fillna(0)
    return counts.withColumn("flip", (F.col("bank_breaks") > 0) & (F.col("book_breaks") == 0) & (F.col("n_balances") >= 2))
