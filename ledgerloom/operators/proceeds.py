"""Cash collected against the proceeds of disposals."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded
from .ledger import date

QUEUE = ["entity_id", "account"]
ORDER = ["day", "line_id"]


def collected_proceeds(lines: DataFrame, proceeds: DataFrame, bank: DataFrame, chart: DataFrame, to: str) -> DataFrame:
    """The cash collected up to a day against each proceeds line: line_id, collected (none: no row).

    ``lines``: line_id, entry_id, entity_id, day, account, debit, credit, bank_id (the bank line behind the
    entry, or null). ``proceeds``: line_id and account of the lines asked for. ``bank``: bank_id, amount.

    An account of an entity is a queue of open debits, of which each credit clears the oldest; credits
    beyond them are advances that absorb the next debits. Of a credit only its cash counts, first of all: what the bank
    line, or the cash debits of an entry without one, still have to give. A later debit of the same bank
    line takes its clearing back, the latest first, and the part without cash before the other.

    Both sides of a queue are laid on one axis of cumulated amounts, where a debit meets the credits at
    its own place: the cash below a place is known from running sums, so nothing is paired. Only the queues
    in which a bank line takes something back are folded row by row (``_fold``), an entity at a time; a bank
    line belongs to one entity."""
    asked = proceeds.select("line_id", F.lit(True).alias("tagged")).distinct()
    accounts = proceeds.select("account", F.lit(True).alias("_queue")).distinct()
    purses = chart.filter("fs_line = 'CASH'").select("account", F.lit(True).alias("_cash")).distinct()
    rows = lines.join(purses, "account", "left").join(accounts, "account", "left").filter("_cash or (_queue and debit <> credit)")
    typed = F.sum(F.when(F.col("_cash") & F.col("bank_id").isNull(), F.greatest("debit", F.lit(0)))).over(Window.partitionBy("entry_id"))
    rows = rows.withColumn("_typed", typed).filter(F.col("_queue") & (F.col("day") <= date(to)))
    given = bank.groupBy("bank_id").agg(F.sum(F.abs("amount")).alias("_given"))
    rows = rows.join(asked, "line_id", "left").join(given, "bank_id", "left").withColumn("net", F.col("debit") - F.col("credit"))
    cash = F.coalesce(F.when(F.col("bank_id").isNotNull(), F.col("_given")).otherwise(F.col("_typed")), F.lit(0))
    source = F.coalesce(F.concat(F.lit("b"), F.col("bank_id").cast("string")), F.concat(F.lit("e"), F.col("entry_id").cast("string")))
    rows = rows.select(*QUEUE, *ORDER, "net", "bank_id", F.coalesce("tagged", F.lit(False)).alias("tagged"), cash.cast("long").alias("cash"), source.alias("source"))

    credit = F.greatest(-F.col("net"), F.lit(0))
    spent = F.sum(credit).over(Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("paid", F.greatest(F.least(F.col("cash") - F.coalesce(spent, F.lit(0)), credit), F.lit(0)))
    by_line = Window.partitionBy(*QUEUE, "source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    takes_back = F.col("bank_id").isNotNull() & (F.col("net") > 0) & F.coalesce(F.min("net").over(by_line) < 0, F.lit(False))
    rows = rows.withColumn("_back", takes_back).withColumn("_back", F.max("_back").over(Window.partitionBy("source")))
    rows = rows.withColumn("_folded", F.max("_back").over(Window.partitionBy(*QUEUE)))

    folds = rows.filter("_folded").select(*QUEUE, *ORDER, "net", "tagged", "paid", F.when(F.col("_back"), F.col("bank_id").cast("string")).alias("back"), "cash")
    kind = lines.schema["line_id"].dataType.simpleString()
    return _on_axis(rows.filter("not _folded")).unionByName(folded(folds, ["entity_id"], ORDER, _fold, f"line_id {kind}, collected long"))


def _on_axis(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy(*QUEUE).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    rows = rows.withColumn("debits", so_far(F.greatest("net", F.lit(0)))).withColumn("credits", so_far(F.greatest(-F.col("net"), F.lit(0)))).withColumn("cash_before", so_far("paid"))
    # a debit's units below the credits before it were paid in advance
    first, last = F.greatest("debits", "credits"), F.col("debits") + F.col("net")
    nothing = F.lit(None).cast("struct<start:bigint,paid:bigint,cash_before:bigint>")
    probe = lambda at, sign: F.struct(at.cast("long").alias("at"), F.lit(sign).alias("sign"), nothing.alias("credit"))
    own = F.struct(F.col("credits").cast("long").alias("start"), F.col("paid").cast("long").alias("paid"), F.col("cash_before").cast("long").alias("cash_before"))
    marks = F.when(F.col("net") < 0, F.array(F.struct(F.col("credits").cast("long").alias("at"), F.lit(0).alias("sign"), own.alias("credit")))).otherwise(F.array(probe(F.least(first, last), -1), probe(last, 1)))
    marks = rows.filter("net < 0 or tagged").select(*QUEUE, "line_id", F.explode(marks).alias("m")).select(*QUEUE, "line_id", "m.*")
    # at one place the credit that starts there comes first
    along = Window.partitionBy(*QUEUE).orderBy("at", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    met = marks.withColumn("met", F.last("credit", ignorenulls=True).over(along)).filter("sign <> 0")
    cash = F.coalesce(F.col("met.cash_before") + F.least(F.col("met.paid"), F.col("at") - F.col("met.start")), F.lit(0))
    return met.groupBy("line_id").agg(F.sum(F.col("sign") * cash).cast("long").alias("collected")).filter("collected <> 0")


def _fold(rows):
    """The queues of an entity's accounts, in which bank lines may take their clearings back."""
    queues, ahead, collected = defaultdict(deque), defaultdict(int), defaultdict(int)
    purse: dict[str, int] = {}  # what a bank line that takes back has left
    done = defaultdict(list)  # its clearings by account: [line or None, amount, cash, advance]
    for r in rows:
        account, back, net = r["account"], r["back"], r["net"]
        queue, mine = queues[account], done[back, account]
        if back is not None:
            purse.setdefault(back, r["cash"])
        while net > 0 and back is not None and mine:
            line, amount, cash, advance = mine.pop()
            taken = min(amount, net)
            cash_taken = max(taken - (amount - cash), 0)
            net -= taken
            purse[back] += cash_taken
            if advance:
                ahead[account] -= taken
            else:
                queue.appendleft([line, taken])
                if line is not None:
                    collected[line] -= cash_taken
            if taken < amount:
                mine.append([line, amount - taken, cash - cash_taken, advance])
        if net > 0:
            absorbed = min(ahead[account], net)
            ahead[account] -= absorbed
            if net > absorbed:
                queue.append([r["line_id"] if r["tagged"] else None, net - absorbed])
        elif net < 0:
            rest = -net
            cash = r["paid"] if back is None else min(purse[back], rest)
            if back is not None:
                purse[back] -= cash
            while rest and queue:
                line, left = queue[0]
                taken = min(left, rest)
                paid = min(taken, cash)
                rest, cash = rest - taken, cash - paid
                if line is not None:
                    collected[line] += paid
                if back is not None:
                    mine.append([line, taken, paid, False])
                queue[0][1] -= taken
                if not queue[0][1]:
                    queue.popleft()
            if rest:
                ahead[account] += rest
                if back is not None:
                    mine.append([None, rest, cash, True])
    return ({"line_id": line, "collected": amount} for line, amount in collected.items() if amount)
