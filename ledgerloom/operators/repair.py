"""Repair of statement rows by their printed balances, and recognition of rows that are already stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ingest import after
from .posting import proved_days


def repaired_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A statement's rows with directions and amounts that its balances prove.

    ``rows``: key, order, amount, balance (or null), balance_only (a row without an amount), and the
    key's opening and closing. Adds ``written`` (the amount as read) and ``note``, and leaves out rows without an amount whose balance
    didn't move.

    A row is FLIPPED if the balance moved by its amount the other way, and a balance-only row takes the
    move as its AMOUNT. Either needs a later printed balance, and all repairs of a statement stand only if
    all its balances and its closing then agree. Else nothing is changed, and what the balances suggest is
    noted as FLIP_UNPROVED or AMOUNT_UNPROVED."""
    along = Window.partitionBy(key).orderBy(order)
    before, later = along.rowsBetween(Window.unboundedPreceding, -1), after(key, order)
    only = F.coalesce("balance_only", F.lit(False))
    rows = rows.withColumn("written", F.when(only, 0).otherwise(F.col("amount")).cast("long"))
    rows = rows.withColumn("_island", F.count("balance").over(before)).withColumn("_base", F.coalesce(F.last("balance", ignorenulls=True).over(before), "opening"))
    inside = Window.partitionBy(key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.col("_base") + F.coalesce(F.sum("written").over(inside), F.lit(0)))
    rows = rows.withColumn("_proof", F.coalesce(F.max(F.col("balance").isNotNull() & ~only).over(later), F.lit(False)))
    moved = only & F.coalesce(F.col("balance") != F.col("_from"), F.lit(False))
    broken = F.coalesce(F.col("balance") != F.col("_from") + F.col("written"), F.lit(False))
    flip = broken & ~only & (F.col("written") != 0) & (F.col("_from") - F.col("written") == F.col("balance"))
    rows = rows.withColumn("_moved", moved).withColumn("_flip", flip).withColumn("_repair", (moved | flip) & F.col("_proof"))
    rows = rows.withColumn("_open", broken & ~F.col("_repair")).withColumn("_end", F.coalesce("balance", F.col("_from") + F.col("written")))
    whole = rows.groupBy(key).agg(F.max("_repair").alias("_any"), F.max("_open").alias("_broken"), F.max_by("_end", order).alias("_last"), F.first("closing").alias("_closing"))
    holds = F.col("_any") & ~F.col("_broken") & F.col("_last").eqNullSafe(F.col("_closing"))
    rows = rows.join(whole.select(key, holds.alias("_holds")), key).filter(~only | F.col("_moved"))
    mends = F.col("_holds") & F.col("_repair")
    amount = F.when(mends & F.col("_moved"), F.col("balance") - F.col("_from")).when(mends, -F.col("written")).otherwise(F.col("written"))
    note = F.when(mends & F.col("_moved"), "AMOUNT").when(mends, "FLIPPED").when(F.col("_holds"), None).when(F.col("_moved"), "AMOUNT_UNPROVED").when(F.col("_flip"), "FLIP_UNPROVED")
    return rows.withColumn("amount", amount.cast("long")).withColumn("note", note).drop(*(c for c in rows.columns if c.startswith("_")))


def overlapping_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of each row of new files: file_id, row_no, decision, stored_id (of the row it is).

    ``rows``: file_id, bank_account, row_no, day, amount, balance, hash, written_hash (of the row as read,
    before repairs; or null), source_hash (of the file), opening (the printed one, or null), first_day and
    last_day of the file. ``stored``: stored_id, bank_account, day, amount, balance, hash, source_hash.

    SAME: from a file of the same bytes. WRITTEN: stored as it was read. PROVED: from another file, of one
    day, amount and balance, where the balances of that day make one chain on both sides. NEW: no stored
    row of its day and amount is left, or the file goes on where the stored rows end and its day is proved.
    REFUSED: neither, so that the file can't be imported. Stored rows count if they lie in the file's days."""
    days = rows.groupBy("file_id", "bank_account").agg(F.least(F.min("day"), F.min("first_day")).alias("lo"), F.greatest(F.max("day"), F.max("last_day")).alias("hi"), F.min("day").alias("first"), F.max("opening").alias("opening"))
    spans = days.select("file_id", "bank_account", F.explode(F.sequence("lo", "hi")).alias("day"))
    known = stored.select("bank_account", "stored_id", F.col("hash").alias("_hash"), F.col("source_hash").alias("_source"))
    same = rows.join(known, [rows["bank_account"] == known["bank_account"], rows["hash"] == known["_hash"], rows["source_hash"] == known["_source"]])
    same = same.select("file_id", "row_no", "stored_id", F.lit("SAME").alias("kind"))
    read = rows.filter("written_hash <> hash")
    read = read.join(known, [read["bank_account"] == known["bank_account"], read["written_hash"] == known["_hash"]]).select("file_id", "row_no", "stored_id", F.lit("WRITTEN").alias("kind"))
    taken = same.unionByName(read).withColumn("_nth", F.row_number().over(Window.partitionBy("file_id", "row_no").orderBy("kind"))).filter("_nth = 1")
    taken = taken.withColumn("_nth", F.row_number().over(Window.partitionBy("file_id", "stored_id").orderBy("row_no"))).filter("_nth = 1").drop("_nth")

    there = stored.select("stored_id", "bank_account", "day", "amount", F.col("balance").alias("_balance")).join(spans, ["bank_account", "day"])
    left = there.join(taken.select("file_id", "stored_id"), ["file_id", "stored_id"], "left_anti")
    twins = left.groupBy("file_id", "day", "amount").agg(F.count("*").alias("twins"), F.count_if(F.col("_balance").isNull()).alias("blank"))
    exact = left.filter("_balance is not null").groupBy("file_id", "day", "amount", F.col("_balance").alias("balance")).agg(F.count("*").alias("exact"), F.min("stored_id").alias("_exact_id"))
    old = proved_days(stored).select("bank_account", "day", F.col("proved").alias("old_proved"), "closing")
    renamed = rows.withColumn("bank_account", F.col("file_id"))  # a file's own days
    new = proved_days(renamed).select(F.col("bank_account").alias("file_id"), "day", F.col("proved").alias("new_proved"))
    last = there.groupBy("file_id", "bank_account").agg(F.max("day").alias("day")).join(old, ["bank_account", "day"])
    goes_on = days.join(last.select("file_id", F.col("day").alias("_last"), "old_proved", "closing"), "file_id").filter("old_proved and closing = opening and _last <= first").select("file_id", F.lit(True).alias("goes_on"))

    met = rows.join(taken, ["file_id", "row_no"], "left").join(twins, ["file_id", "day", "amount"], "left").join(exact, ["file_id", "day", "amount", "balance"], "left")
    met = met.join(old.drop("closing"), ["bank_account", "day"], "left").join(new, ["file_id", "day"], "left").join(goes_on, "file_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    proved = F.col("kind").isNull() & yes(F.col("exact") == 1) & yes(F.col("old_proved")) & yes(F.col("new_proved"))
    met = met.withColumn("_proved", proved)
    used = F.coalesce(F.sum(F.col("_proved").cast("long")).over(Window.partitionBy("file_id", "day", "amount").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.coalesce("twins", F.lit(0)) - used
    on = yes(F.col("goes_on")) & yes(F.col("new_proved")) & F.col("balance").isNotNull() & (F.col("blank") == 0) & F.col("exact").isNull()
    met = met.withColumn("_free", free)
    decision = F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("_proved"), "PROVED").when((F.col("_free") <= 0) | on, "NEW").otherwise("REFUSED")
    return met.select("file_id", "row_no", decision.alias("decision"), F.coalesce("stored_id", F.when(F.col("_proved"), F.col("_exact_id"))).alias("stored_id"))
