"""Corrections of suspense, removal of imports, and suggestions that the books don't back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ledger import date, total

SUSPENSE = "1999"
#: The confidence of a suggestion that would settle what the books don't hold, in percent.
UNBACKED = 55


def suspense_corrections(lines: DataFrame, decided: DataFrame, start: str, end: str) -> DataFrame:
    """What would take the differences of source files off suspense, of the span's lines: entity_id,
    line_id (null for a remainder), entry_id, amount (debits less credits that the correction takes off), counter.

    ``lines``: line_id, entry_id, entry_kind, entity_id, day, account, debit, credit, source (whether a suspense line
    holds the difference of an imported file). Lines of bank entries wait for their review and don't count. ``decided``: the line_id of lines corrected already. A line is
    reversed while the entity's difference up to the span's end still holds it, and so the balance
    moves toward zero and never past it. An entity none of whose lines fit gets one correction of all that is
    left, at its last line. ``counter`` is the account of the one other line of the entry with the same amount, or null."""
    net = F.col("debit") - F.col("credit")
    open_ = lines.filter((F.col("account") == SUSPENSE) & (F.col("day") <= date(end)) & (F.col("entry_kind") != "BANK"))
    left = open_.groupBy("entity_id").agg(total(net).alias("_left"))
    own = open_.filter(F.col("source") & (F.col("day") >= date(start))).withColumn("amount", net)
    own = own.join(left, "entity_id").join(decided.select("line_id", F.lit(True).alias("_done")).distinct(), "line_id", "left")
    holds = F.when(F.col("amount") > 0, F.col("_left") >= F.col("amount")).otherwise(F.col("_left") <= F.col("amount"))
    own = own.withColumn("_fits", F.col("_done").isNull() & holds)
    own = own.withColumn("_any", F.max("_fits").over(Window.partitionBy("entity_id"))).withColumn("_nth", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("day"), F.desc("line_id"))))
    same = lines.filter(F.col("account") != SUSPENSE).select("entry_id", F.col("account").alias("_other"), F.explode(F.array_distinct(F.array("debit", "credit"))).alias("_size")).filter("_size <> 0")
    same = same.groupBy("entry_id", "_size").agg(F.count("*").alias("_n"), F.first("_other").alias("_other")).filter("_n = 1")
    fine = own.filter("_fits").withColumn("_size", F.abs("amount")).join(same, ["entry_id", "_size"], "left")
    fine = fine.select("entity_id", "line_id", "entry_id", "amount", F.col("_other").alias("counter"))
    rest = own.filter("not _any and _nth = 1 and _left <> 0")
    return fine.unionByName(rest.select("entity_id", F.lit(None).cast(lines.schema["line_id"].dataType).alias("line_id"), "entry_id", F.col("_left").alias("amount"), F.lit(None).cast("string").alias("counter")))


def import_removals(imports: DataFrame, lines: DataFrame, rests: DataFrame, locked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which imports can be removed, and what each would take off: import_id, n_entries, n_lines, reason,
    names (the first three that stand in the way) and n_names; and import_id, account, net of those that can.

    ``imports``: import_id, entity_id, kind (STATEMENT or LEDGER), status. ``lines``: import_id, entry_id, entity_id, entry_kind,
    day, account, debit, credit. ``rests``: what rests on an entry or entity: kind, name, entry_id or entity_id, day. ``locked``:
    entity_id, month (index) of closed months.

    Reasons, the first that holds: DRAFT; SETTLED (a bank line settles an invoice); LOCKED (an entry lies in a closed month); RESTING (a schedule or
    an asset was made from an entry); REVERSED (a reversal names an entry); OPENING (assets from before
    the books or opening invoices rest on an opening); BRIDGE (another import's opening was built from the
    books up to a day, on which or before which an entry lies); PAIR (the other half of a transfer lies in a closed month)."""
    month = lambda day: (F.year(day) * 12 + F.month(day) - 1).cast("int")
    entries = lines.groupBy("import_id", "entry_id").agg(F.min("entity_id").alias("entity_id"), F.min("day").alias("day"), F.min("entry_kind").alias("entry_kind"), F.count("*").alias("_n"))
    closed = locked.select("entity_id", F.col("month").alias("_month")).distinct()
    shut = entries.withColumn("_month", month("day")).join(closed, ["entity_id", "_month"])
    shut = shut.select("import_id", F.lit("LOCKED").alias("reason"), F.concat_ws("-", F.expr("_month div 12").cast("string"), F.lpad((F.col("_month") % 12 + 1).cast("string"), 2, "0")).alias("name"))
    direct = rests.filter("kind in ('SETTLEMENT', 'SCHEDULE', 'ASSET', 'REVERSAL')")
    direct = entries.select("import_id", "entry_id").join(direct.select("entry_id", "kind", "name"), "entry_id")
    word = F.when(F.col("kind") == "SETTLEMENT", "SETTLED").when(F.col("kind") == "REVERSAL", "REVERSED").otherwise("RESTING")
    direct = direct.select("import_id", word.alias("reason"), "name")
    pairs = rests.filter("kind = 'PAIR'").withColumn("_month", month("day")).select("entry_id", "name", F.col("entity_id"), "_month").join(closed, ["entity_id", "_month"])
    pairs = entries.select("import_id", "entry_id").join(pairs.select("entry_id", "name"), "entry_id").select("import_id", F.lit("PAIR").alias("reason"), "name")
    # an asset from before the books rests on an opening if it was there by then, or brings depreciation of its own
    first = entries.filter("entry_kind = 'OPENING'").groupBy("import_id", "entity_id").agg(F.max("day").alias("_opened"))
    stands = first.join(rests.filter("kind in ('OLD_ASSET', 'OPENING_INVOICE')").select("entity_id", "name", "day"), "entity_id").filter("day is null or day <= _opened")
    stands = stands.select("import_id", F.lit("OPENING").alias("reason"), "name")
    early = entries.groupBy("import_id", "entity_id").agg(F.min("day").alias("_first"))
    built = rests.filter("kind = 'BRIDGE'").select("entity_id", "name", "day", F.col("import_id").alias("_by"))
    built = early.join(built, "entity_id").filter((F.col("_first") <= F.col("day")) & (F.col("_by") != F.col("import_id"))).select("import_id", F.lit("BRIDGE").alias("reason"), "name")
    drafts = imports.filter("kind = 'LEDGER' and status <> 'POSTED'").select("import_id", F.lit("DRAFT").alias("reason"), F.lit(None).cast("string").alias("name"))
    ranks = ("DRAFT", "SETTLED", "LOCKED", "RESTING", "REVERSED", "OPENING", "BRIDGE", "PAIR")
    found = drafts
    for more in (shut, direct, pairs, stands, built):
        found = found.unionByName(more)
    found = found.distinct().withColumn("_rank", F.array_position(F.array(*map(F.lit, ranks)), F.col("reason")))
    found = found.groupBy("import_id", "reason", "_rank").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 3), ", ").alias("names"), F.count("name").alias("n_names"))
    found = found.groupBy("import_id").agg(F.min_by(F.struct("reason", "names", "n_names"), "_rank").alias("_f"))
    sizes = entries.groupBy("import_id").agg(F.count("*").alias("n_entries"), F.sum("_n").alias("n_lines"))
    heads = imports.select("import_id").join(sizes, "import_id", "left").join(found, "import_id", "left")
    heads = heads.select("import_id", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "_f.reason", "_f.names", F.coalesce("_f.n_names", F.lit(0)).alias("n_names"))
    nets = lines.join(heads.filter("reason is null").select("import_id"), "import_id", "left_semi").groupBy("import_id", "account").agg(total(F.col("debit") - F.col("credit")).alias("net")).filter("net <> 0")
    return heads, nets


def backed_suggestions(suggestions: DataFrame, lines: DataFrame, chart: DataFrame) -> DataFrame:
    """Suggestions of a model that would settle a receivable by money in, or a payable by money out, that the
    entity's books don't hold on that day are brought down to UNBACKED and given a ``reason``.

    ``suggestions``: line_id, entity_id, day, amount, account, method, confidence_pct. The open balances and the
    suggestions of an entity pass by as one stream of days; balances are summed by day before."""
    kinds = F.broadcast(chart.select("account", "fs_line"))  # a fixed list
    net = F.col("debit") - F.col("credit")
    moved = lines.join(kinds.filter("fs_line in ('RECEIVABLES', 'PAYABLES')"), "account").groupBy("entity_id", "day").agg(
        total(F.when(F.col("fs_line") == "RECEIVABLES", net)).alias("receivable"), total(F.when(F.col("fs_line") == "PAYABLES", -net)).alias("payable")
    )
    asked = suggestions.withColumns({"receivable": F.lit(0).cast("long"), "payable": F.lit(0).cast("long"), "_asked": F.lit(True)})
    along = Window.partitionBy("entity_id").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(moved.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    rows = rows.withColumns({"receivable": F.sum("receivable").over(along), "payable": F.sum("payable").over(along)}).filter("_asked").join(kinds, "account", "left")
    model = F.col("method") == "AI"
    reason = (
        F.when(model & (F.col("amount") > 0) & (F.col("fs_line") == "RECEIVABLES") & (F.col("receivable") <= 0), "NO_RECEIVABLE")
        .when(model & (F.col("amount") < 0) & (F.col("fs_line") == "PAYABLES") & (F.col("payable") <= 0), "NO_PAYABLE")
    )
    rows = rows.withColumn("reason", reason)
    confidence = F.when(F.col("reason").isNotNull(), F.least("confidence_pct", F.lit(UNBACKED))).otherwise(F.col("confidence_pct"))
    return rows.withColumn("confidence_pct", confidence).select(*suggestions.columns, "reason")
