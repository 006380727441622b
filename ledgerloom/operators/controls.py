"""Checks of the books: each is a key and a status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import date, total


def entry_checks(lines: DataFrame, locked_before: str) -> DataFrame:
    """Invariants of entries, with the number of those that break each: an entry balances and has two
    lines at least, one side of a line is set, an entry has one date and entity, locked months are shut."""
    entries = lines.groupBy("entry_id").agg(
        (F.sum("debit") != F.sum("credit")).alias("unbalanced"),
        (F.count("*") < 2).alias("one_line"),
        ((F.min("day") != F.max("day")) | (F.min("entity_id") != F.max("entity_id"))).alias("mixed"),
        F.count_if((F.col("debit") < 0) | (F.col("credit") < 0) | ((F.col("debit") == 0) == (F.col("credit") == 0))).alias("sides"),
        F.count_if(F.col("day") < date(locked_before)).alias("locked"),
    )
    sums = entries.agg(
        F.count_if("unbalanced").alias("UNBALANCED"), F.count_if("one_line").alias("ONE_LINE"), total("sides").alias("SIDES"), F.count_if("mixed").alias("MIXED_DATES"), total("locked").alias("LOCKED_MONTH")
    )
    return sums.unpivot([], sums.columns, "check_key", "n")


def entity_controls(tb: DataFrame, proof: DataFrame) -> DataFrame:
    """Seven of the month-close checks of each entity (the README lists the others), from one trial balance and the subledger proof."""
    of = lambda cond, sign=1: total(F.when(cond, F.col("net") * sign))
    asset, liability = F.col("type") == "ASSET", F.col("type") == "LIABILITY"
    wrong = (asset & (F.col("kind") != "INTERCOMPANY") & (F.col("net") < 0)) | (liability & (F.col("net") > 0))
    rows = tb.groupBy("client_id", "entity_id").agg(
        total("net").alias("tb"),
        of(asset).alias("assets"),
        of(F.col("type").isin("EQUITY", "INCOME", "EXPENSE"), -1).alias("equity"),
        F.count_if(wrong).alias("wrong"),
        of(F.col("account") == "1199").alias("clearing"),
        of(F.col("fs_line") == "REVENUE", -1).alias("sales"),
        of(F.col("fs_line") == "COGS").alias("cogs"),
    )
    rows = rows.join(proof.select("entity_id", "difference"), "entity_id", "left")
    checks = [
        ("TRIAL_BALANCE", F.col("tb") != 0, "FAIL"),
        ("NEGATIVE_ASSETS", F.col("assets") < 0, "REVIEW"),
        ("CAPITAL_DEFICIENCY", F.col("equity") < 0, "REVIEW"),
        ("WRONG_SIDE", F.col("wrong") > 0, "REVIEW"),
        ("CLEARING", F.col("clearing") != 0, "FAIL"),
        ("SALES_WITHOUT_COST", (F.col("sales") > 0) & (F.col("cogs") == 0), "REVIEW"),
        ("RECEIVABLES_PROOF", F.coalesce("difference", F.lit(0)) != 0, "FAIL"),
    ]
    found = F.array(*[F.struct(F.lit(k).alias("check_key"), F.when(bad, s).otherwise("PASS").alias("status")) for k, bad, s in checks])
    return rows.select("client_id", "entity_id", F.inline(found))


def readiness(controls: DataFrame, notes: DataFrame) -> DataFrame:
    """Entities that may close: no FAIL, and no REVIEW without a note (entity_id, check_key)."""
    open_ = controls.filter("status <> 'PASS'").join(notes.withColumn("noted", F.lit(True)), ["entity_id", "check_key"], "left")
    blocks = open_.filter("status = 'FAIL' or noted is null").groupBy("entity_id").agg(F.count("*").alias("n_blocking"))
    return controls.select("client_id", "entity_id").distinct().join(blocks, "entity_id", "left").fillna(0, ["n_blocking"]).withColumn("ready", F.col("n_blocking") == 0)


def completeness(rows: DataFrame, year: int, least: int = 1) -> DataFrame:
    """Entity by month of a year: before the first data, missing, broken (fewer than ``least``) or ok."""
    entities = rows.select("entity_id").distinct()
    found = rows.filter(F.year("day") == year).groupBy("entity_id", F.month("day").alias("month")).agg(F.count("*").alias("n"))
    first = found.groupBy("entity_id").agg(F.min("month").alias("first"))
    cells = entities.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    cells = cells.join(found, ["entity_id", "month"], "left").join(first, "entity_id", "left")
    state = F.when(F.col("first").isNull() | (F.col("month") < F.col("first")), "BEFORE").when(F.col("n").isNull(), "MISSING").when(F.col("n") < least, "BROKEN").otherwise("OK")
    return cells.select("entity_id", "month", state.alias("state"))


def opening_controls(lines: DataFrame, start: str, end: str, difference: str = "3290") -> DataFrame:
    """By entity with lines up to ``end``, entity_id, check_key, status, amount of two checks.

    OPENING_DIFFERENCE fails while the account that took an opening's imbalance holds money. OPENING_RECORDED is to be
    reviewed in the month in which the books begin without an OPENING or an IMPORTED entry: their first balance is zero."""
    held = lines.filter(F.col("day") <= date(end)).groupBy("entity_id").agg(
        total(F.when(F.col("account") == difference, F.col("debit") - F.col("credit")).otherwise(0)).alias("amount"),
        F.min("day").alias("first"),
    )
    # an opening may be dated at any day, and an import be recorded later
    begun = lines.groupBy("entity_id").agg(F.max(F.col("entry_kind").isin("OPENING", "IMPORTED")).alias("begun"))
    rows = held.join(begun, "entity_id")
    asked = ~F.col("begun") & (F.col("first") >= date(start))
    cells = F.array(
        F.struct(F.lit("OPENING_DIFFERENCE").alias("check_key"), F.when(F.col("amount") != 0, "FAIL").otherwise("PASS").alias("status"), F.abs("amount").alias("amount")),
        F.struct(F.lit("OPENING_RECORDED").alias("check_key"), F.when(asked, "REVIEW").otherwise("PASS").alias("status"), F.lit(0).cast("long").alias("amount")),
    )
    return rows.select("entity_id", F.inline(cells))


def foreign_banks(lines: DataFrame, banks: DataFrame, end: str) -> DataFrame:
    """Entities whose books hold money on a bank account of another entity: entity_id, amount, accounts (a text).

    ``banks``: account, entity_id of its owner; an account with several owners is foreign to each entity that isn't the only one."""
    owners = banks.select("account", F.col("entity_id").alias("owner")).distinct()
    sums = lines.filter(F.col("day") <= date(end)).groupBy("entity_id", "account").agg(total(F.col("debit") - F.col("credit")).alias("net")).filter("net <> 0")
    others = sums.join(owners, "account").filter(F.col("owner") != F.col("entity_id")).select("entity_id", "account", "net").distinct()
    return others.groupBy("entity_id").agg(total("net").alias("amount"), F.array_join(F.array_sort(F.collect_list("account")), ", ").alias("accounts"))
