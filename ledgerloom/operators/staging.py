"""Staging of ledger files: rows as planned entries, what is wrong with them, and the parts of trial balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_index
from ..functions.money import EXPONENTS, cents_to_minor, convert_minor, exponent, power10
from .ledger import total

ROUNDING = "7190"
GROUP = ["file_id", "entity_key", "voucher", "day"]


def sided(rows: DataFrame) -> DataFrame:
    """Amounts below zero on the other side, where they are the same number; ``negative`` says which rows had one."""
    debit, credit = F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))
    moved = credit - F.least(debit, F.lit(0))
    return rows.withColumns({
        "negative": (debit < 0) | (credit < 0), "written_debit": debit, "written_credit": credit,
        "debit": (F.greatest(debit, F.lit(0)) - F.least(moved, F.lit(0))).cast("long"), "credit": F.greatest(moved, F.lit(0)).cast("long"),
    })


def _usable(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """All rows with their entity's currency; ``usable`` unless they can't be read or say an unknown entity or currency."""
    known = F.col("currency").isNull() | F.col("currency").isin(*EXPONENTS)
    rows = sided(rows.withColumn("entity_key", F.coalesce("entity_key", F.lit("")))).join(entities.select("entity_key", F.col("currency").alias("own")), "entity_key", "left")
    rows = rows.withColumn("foreign", F.when(F.col("currency") != F.col("own"), F.col("currency")))
    return rows.withColumn("usable", F.col("error").isNull() & F.col("own").isNotNull() & known)


def _planned(rows: DataFrame, rates: DataFrame | None) -> DataFrame:
    """Usable rows with their group, amount (minor units of the entity's currency, debits positive, null without a rate) and
    cents (the amount that is rounded with its group)."""
    some = rows.filter("usable")
    by_file = Window.partitionBy("file_id")
    text = F.coalesce("voucher", F.lit(""))
    some = some.withColumn("voucher", F.when(F.max(text != "").over(by_file), text).otherwise("")).withColumn("signed", F.col("debit") - F.col("credit"))
    if rates is None:
        return some.withColumn("converted", F.lit(False)).withColumn("cents", F.col("signed")).withColumn("amount", cents_to_minor(F.col("signed"), F.col("own")))
    there = rates.select(F.col("currency").alias("foreign"), F.col("to").alias("own"), "day", F.col("rate_num").alias("_num"), F.col("rate_scale").alias("_scale"))
    some = some.join(there, ["foreign", "own", "day"], "left")
    num, scale = F.coalesce("rate_num", "_num"), F.when(F.col("rate_num").isNotNull(), F.col("rate_scale")).otherwise(F.col("_scale"))
    minor = cents_to_minor(F.abs("signed"), F.col("foreign"))
    functional = F.signum("signed").cast("int") * convert_minor(minor, num, scale, F.col("foreign"), F.col("own"))
    foreign = F.col("foreign").isNotNull()
    some = some.withColumn("amount", F.when(foreign, functional).otherwise(cents_to_minor(F.col("signed"), F.col("own"))).cast("long"))
    cents = F.when(foreign, F.col("amount") * power10(2 - exponent(F.col("own"))).cast("decimal(3,0)")).otherwise(F.col("signed"))
    return some.withColumn("cents", cents.cast("long")).withColumn("converted", foreign).drop("_num", "_scale")


def _entries(planned: DataFrame) -> DataFrame:
    """A row per group: sums, the residue of rounding, and what debits and credits are apart."""
    source = F.coalesce("foreign", "own")
    by_currency = planned.groupBy(*GROUP, "own", source.alias("_source")).agg(
        F.sum("signed").alias("_signed"), F.sum("cents").alias("_cents"), F.sum("amount").alias("_amount"), F.sum(F.greatest("amount", F.lit(0))).alias("_debit"),
        F.count_if("converted").alias("_converted"), F.count_if(F.col("amount").isNull()).alias("_missing"), F.count("*").alias("_n"), F.min("row_no").alias("_first"),
    )
    rows = by_currency.groupBy(*GROUP, "own").agg(
        total("_cents").alias("_cents"), total("_amount").alias("_sum"), total("_debit").alias("debit"), F.sum("_converted").alias("_converted"), F.sum("_missing").alias("_missing"),
        F.sum("_n").alias("n_rows"), F.min("_first").alias("first_row"), F.bool_and(F.col("_signed") == 0).alias("_even"), F.count("*").alias("n_currencies"),
    ).filter("_missing = 0")
    rows = rows.withColumn("_total", cents_to_minor(F.col("_cents"), F.col("own")).cast("long")).withColumn("_residue", F.col("_total") - F.col("_sum"))
    # each converted row may be a minor unit off; what balances in all currencies of the file is no difference
    of_rates = (F.col("_converted") > 0) & (F.col("_total") != 0) & (F.abs("_total") <= F.col("_converted")) & F.col("_even")
    rows = rows.withColumn("fx_rounding", of_rates)
    rows = rows.withColumn("rounding", F.when(of_rates, F.col("_residue") - F.col("_total")).otherwise(F.col("_residue")))
    return rows.withColumn("imbalance", F.when(of_rates, 0).otherwise(F.col("_total")).cast("long"))


def planned_entries(rows: DataFrame, entities: DataFrame, rates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """T5: the entries that files plan, one for each entity, voucher and day, and their lines.

    ``rows``: file_id, row_no, entity_key, day, code, name, debit, credit (hundredths), currency, rate_num, rate_scale (or
    null), voucher, error (why the row can't be read, or null). ``entities``: entity_key, currency. With ``rates`` (currency, to,
    day, rate_num, rate_scale) rows of another currency are converted, and an entry with a row that has no rate is left out; without
    them numbers stand as they are. A file without any voucher groups by day.

    Entries: the keys, n_rows, debit, rounding, fx_rounding, imbalance. Lines: the keys, row_no, code, name, amount (debits
    positive); each amount is rounded to the entity's minor unit, and one line of ROUNDING carries what is left so that the
    entry sums to its rounded total."""
    planned = _planned(_usable(rows, entities), rates)
    heads = _entries(planned)
    lines = planned.join(heads.select(*GROUP), GROUP, "left_semi").select(*GROUP, "row_no", "code", "name", "amount")
    residue = heads.filter("rounding <> 0").select(*GROUP, F.lit(None).cast("int").alias("row_no"), F.lit(ROUNDING).alias("code"), F.lit("Rounding").alias("name"), F.col("rounding").alias("amount"))
    return heads.select(*GROUP, "n_rows", "debit", "rounding", "fx_rounding", "imbalance"), lines.unionByName(residue)


def staging_findings(rows: DataFrame, entities: DataFrame, rates: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """T5: what is to be said of files before they are posted: file_id, severity, code, entity_key, about, n_rows, first_row, amount.

    BLOCK: ROW_ERROR, UNKNOWN_ENTITY, UNKNOWN_CURRENCY, UNBALANCED (by entry), MISSING_RATE. REVIEW: NEGATIVE_AMOUNT, TOTAL_MISMATCH,
    CODE_RENAMED, FX_SAME_NUMBER (an entry of several currencies that balances only as numbers), FX_NO_RATE, MISSING_MONTH. INFO: TOTAL_OK.
    ``totals``: file_id, row_no, debit, credit of total rows; the last one is held against the rows as written, and differs only if
    no other one is larger."""
    every = _usable(rows, entities)
    planned = _planned(every, rates)
    heads = _entries(planned)
    none, blank = F.lit(None).cast("long"), F.lit("")

    def found(df, severity, code, by, about=blank, amount=none, row="row_no"):
        kinds = df.withColumn("_about", about.cast("string"))
        return kinds.groupBy("file_id", *by, "_about").agg(F.count("*").alias("n_rows"), F.min(row).cast("long").alias("first_row"), amount.cast("long").alias("amount")).select(
            "file_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("entity_key") if by else blank.alias("entity_key"), F.col("_about").alias("about"), "n_rows", "first_row", "amount"
        )

    key = ["entity_key"]
    out = found(every.filter("error is not null"), "BLOCK", "ROW_ERROR", key, F.col("error"))
    out = out.unionByName(found(every.filter("own is null"), "BLOCK", "UNKNOWN_ENTITY", key))
    out = out.unionByName(found(every.filter(F.col("currency").isNotNull() & ~F.col("currency").isin(*EXPONENTS)), "BLOCK", "UNKNOWN_CURRENCY", [], F.col("currency")))
    out = out.unionByName(found(planned.filter("negative"), "REVIEW", "NEGATIVE_AMOUNT", []))
    entry = lambda df, severity, code, amount=none: df.select(
        "file_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), "entity_key", F.concat_ws(" ", F.nullif("voucher", blank), F.col("day").cast("string")).alias("about"), "n_rows", F.col("first_row").cast("long").alias("first_row"), amount.alias("amount")
    )
    out = out.unionByName(entry(heads.filter("imbalance <> 0"), "BLOCK", "UNBALANCED", F.col("imbalance")))
    apart = planned.filter("foreign is not null")
    if rates is None:
        out = out.unionByName(entry(heads.filter("imbalance = 0 and n_currencies > 1"), "REVIEW", "FX_SAME_NUMBER"))
        out = out.unionByName(found(apart, "REVIEW", "FX_NO_RATE", key, F.col("foreign"), cents_to_minor(F.sum(F.col("debit") + F.col("credit")), F.first("own"))))
    else:
        out = out.unionByName(found(apart.filter("amount is null"), "BLOCK", "MISSING_RATE", key, F.concat_ws(" ", "foreign", F.col("day").cast("string"))))
    named = planned.filter("name <> code").groupBy("file_id", "entity_key", "code").agg(F.count_distinct(F.lower(F.trim("name"))).alias("_names"), F.count("*").alias("n_rows"), F.min("row_no").cast("long").alias("first_row"))
    out = out.unionByName(named.filter("_names > 1").select("file_id", F.lit("REVIEW").alias("severity"), F.lit("CODE_RENAMED").alias("code"), "entity_key", F.col("code").alias("about"), "n_rows", "first_row", none.alias("amount")))
    months = planned.select("file_id", "entity_key", month_index("day").alias("_m")).groupBy("file_id", "entity_key").agg((F.max("_m") - F.min("_m") + 1 - F.count_distinct("_m")).cast("long").alias("_gaps"))
    out = out.unionByName(months.filter("_gaps > 0").select("file_id", F.lit("REVIEW").alias("severity"), F.lit("MISSING_MONTH").alias("code"), "entity_key", F.col("_gaps").cast("string").alias("about"), F.lit(0).cast("long").alias("n_rows"), none.alias("first_row"), none.alias("amount")))
    if totals is not None:
        grand = totals.groupBy("file_id").agg(F.max_by(F.struct("debit", "credit"), "row_no").alias("g"), F.max("row_no").cast("long").alias("first_row"), F.max("debit").alias("_most"))
        sums = every.filter("error is null").groupBy("file_id").agg(total("written_debit").alias("_d"), total("written_credit").alias("_c"), F.count("*").alias("n_rows"))
        held = grand.join(sums, "file_id", "left").fillna(0, ["_d", "_c", "n_rows"])
        fine = (F.col("g.debit") == F.col("_d")) & (F.col("g.credit") == F.col("_c"))
        held = held.filter(fine | (F.col("_most") <= F.col("g.debit")))
        out = out.unionByName(held.select("file_id", F.when(fine, "INFO").otherwise("REVIEW").alias("severity"), F.when(fine, "TOTAL_OK").otherwise("TOTAL_MISMATCH").alias("code"), blank.alias("entity_key"), blank.alias("about"), "n_rows", "first_row", (F.col("g.debit") - F.col("_d")).cast("long").alias("amount")))
    return out


def trial_balance_parts(rows: DataFrame) -> DataFrame:
    """Opening, adjustment, adjusted, movement and closing of each row, from its own columns or derived, and whether they tie.

    ``rows``: file_id, code and any of opening, unadjusted, adjustment, adjusted, movement, closing (null where the file lacks the column
    or the cell is empty). A file has a column if a row does. Without an adjustment it is what adjusted and the balance before it are apart;
    without a balance before it the opening is what is left. ``problem``: LAYOUT (two kinds of balances before adjustment),
    ADJUSTED or CLOSING (the row's own columns don't add up), else null."""
    names = ("opening", "unadjusted", "adjustment", "adjusted", "movement", "closing")
    whole = Window.partitionBy("file_id")
    rows = rows.withColumns({f"_{n}": F.max(F.col(n).isNotNull()).over(whole) for n in names}).withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    c = F.col
    base = F.when(c("_opening"), c("opening")).when(c("_unadjusted"), c("unadjusted"))
    derived = ~c("_adjustment") & c("_adjusted") & (c("_opening") | c("_unadjusted"))
    rows = rows.withColumn("_a", F.when(derived, c("adjusted") - base).otherwise(c("adjustment")))
    rows = rows.withColumn("_o", F.coalesce(base, F.when(c("_adjusted"), c("adjusted") - c("_a")).otherwise(c("closing") - c("movement") - c("_a"))))
    rows = rows.withColumn("_d", F.when(c("_adjusted"), c("adjusted")).otherwise(c("_o") + c("_a")))
    rows = rows.withColumn("_m", F.when(c("_movement"), c("movement")).when(c("_closing"), c("closing") - c("_d")).otherwise(0))
    rows = rows.withColumn("_c", F.when(c("_closing"), c("closing")).otherwise(c("_d") + c("_m")))
    problem = (
        F.when(c("_opening") & c("_unadjusted"), "LAYOUT")
        .when(c("_adjusted") & c("_adjustment") & (c("_opening") | c("_unadjusted")) & (c("_o") + c("_a") != c("_d")), "ADJUSTED")
        .when(c("_closing") & c("_movement") & (c("_d") + c("_m") != c("_c")), "CLOSING")
    )
    return rows.select("file_id", "code", c("_o").alias("opening"), c("_a").alias("adjustment"), c("_d").alias("adjusted"), c("_m").cast("long").alias("movement"), c("_c").alias("closing"), problem.alias("problem"))
