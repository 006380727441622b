"""Posting: entries as sets of lines that are accepted or refused with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ledger import date, total

DIFFERENCE, RETAINED = "3290", "3200"


def _swapped(lines: DataFrame, entry_id, day, *more) -> DataFrame:
    return lines.select(entry_id.alias("entry_id"), "entity_id", day.alias("day"), "account", F.col("credit").alias("debit"), F.col("debit").alias("credit"), *more)


def _some(lines: DataFrame) -> DataFrame:
    """Lines that are not zero on both sides; a missing side is zero."""
    lines = lines.withColumns({side: F.coalesce(side, F.lit(0).cast("long")) for side in ("debit", "credit")})
    return lines.filter("debit <> 0 or credit <> 0")


def post_checks(lines: DataFrame, chart: DataFrame, locked_until: str) -> DataFrame:
    """Each entry with the number of its lines that aren't zero and the first reason why it can't be
    posted, or null: SIDES (a negative side or both sides set), ONE_LINE (fewer than two lines that aren't zero),
    UNBALANCED, MIXED (several days or entities), ACCOUNT (not in the chart), LOCKED."""
    known = F.broadcast(chart.select("account", F.lit(True).alias("_known")))  # a fixed list
    lines = lines.withColumns({side: F.coalesce(side, F.lit(0).cast("long")) for side in ("debit", "credit")}).join(known, "account", "left")
    some = lambda c: F.when((F.col("debit") != 0) | (F.col("credit") != 0), c)
    sums = lines.groupBy("entry_id").agg(
        F.count(some(F.lit(1))).alias("n"),
        F.bool_and(some((F.least("debit", "credit") == 0) & (F.greatest("debit", "credit") > 0))).alias("sides"),
        total(some(F.col("debit") - F.col("credit"))).alias("net"),
        F.min(some(F.col("day"))).alias("day"),
        F.max(some(F.col("day"))).alias("last"),
        (F.min(some(F.col("entity_id"))) == F.max(some(F.col("entity_id")))).alias("one"),
        F.bool_and(some(F.coalesce("_known", F.lit(False)))).alias("known"),
    )
    reason = (
        F.when(~F.coalesce("sides", F.lit(True)), "SIDES")
        .when(F.col("n") < 2, "ONE_LINE")
        .when(F.col("net") != 0, "UNBALANCED")
        .when((F.col("day") != F.col("last")) | ~F.col("one"), "MIXED")
        .when(~F.col("known"), "ACCOUNT")
        .when(F.col("day") <= date(locked_until), "LOCKED")
    )
    return sums.select("entry_id", "n", reason.alias("reason"))


def posted(lines: DataFrame, chart: DataFrame, locked_until: str) -> DataFrame:
    """The lines, but for those that are zero, of the entries that ``post_checks`` accepts."""
    fine = post_checks(lines, chart, locked_until).filter("reason is null").select("entry_id")
    return _some(lines).join(fine, "entry_id", "left_semi")


#: What may own an entry, which is then changed there and not reversed, in the order in which it is named.
OWNERS = ("IMPORT", "DONE", "REVERSAL", "SCHEDULE", "TAX", "LEASE", "BENEFIT", "INVENTORY", "PROPOSAL", "ASSET", "CURRENCY")


def reversals(lines: DataFrame, requests: DataFrame, kind: str = "MANUAL", owned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines that reverse the requested entries (entry_id, day), sides swapped, and the refused
    requests with a reason: UNKNOWN, KIND (only ``kind`` is reversed so), an owner, AGAIN (``reverses_id`` of a line
    names it), REVERSAL (it is one itself), EARLY (before the entry), or AGAIN, if an earlier request could do it.

    ``owned``: entry_id, owner: the entries that belong to an import, a schedule and so on, or hold foreign
    currency; see OWNERS. ``reverses_id`` is read where the lines have it."""
    # an entry's lines combine before their shuffle; its kind is that of each of its lines
    heads = lines.groupBy("entry_id").agg(F.max(F.col("entry_kind") == kind).alias("_kind"), F.min("day").alias("_day")).join(requests.select("entry_id").distinct(), "entry_id", "left_semi")
    none = requests.select("entry_id").limit(0).withColumn("owner", F.lit(""))
    owners = owned.select("entry_id", "owner") if owned is not None else none
    if "reverses_id" in lines.columns:
        back = lines.filter("reverses_id is not null")
        owners = owners.unionByName(back.select(F.col("reverses_id").alias("entry_id"), F.lit("DONE").alias("owner"))).unionByName(back.select("entry_id", F.lit("REVERSAL").alias("owner")))
    rank = F.array_position(F.array(*map(F.lit, OWNERS)), F.col("owner"))
    owners = owners.join(requests.select("entry_id").distinct(), "entry_id", "left_semi").groupBy("entry_id").agg(F.min_by("owner", rank).alias("_owner"))
    rows = requests.join(heads, "entry_id", "left").join(owners, "entry_id", "left")
    reason = (
        F.when(F.col("_kind").isNull(), "UNKNOWN")
        .when(~F.col("_kind"), "KIND")
        .when(F.col("_owner") == "DONE", "AGAIN")
        .when(F.col("_owner").isNotNull(), F.col("_owner"))
        .when(F.col("day") < F.col("_day"), "EARLY")
    )
    rows = rows.select("entry_id", "day", reason.alias("reason"))
    nth = F.row_number().over(Window.partitionBy("entry_id", F.col("reason").isNull()).orderBy("day"))
    rows = rows.withColumn("_nth", nth).select("entry_id", "day", F.coalesce("reason", F.when(F.col("_nth") > 1, "AGAIN")).alias("reason"))
    fine = rows.filter("reason is null").select("entry_id", F.col("day").alias("_on"))
    made = _swapped(lines.filter(F.col("entry_kind") == kind).join(fine, "entry_id"), F.concat(F.lit("R"), "entry_id"), F.col("_on"), F.col("entry_id").alias("reverses_id"))
    return made, rows.filter("reason is not null")


def openings(typed: DataFrame, lines: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """T4: an opening entry of each entity's typed balances (entity_id, account, debit, credit), where what
    they are apart goes to the difference account, and one row per entity: difference and reason. Refused
    are entities with an opening already (AGAIN), with bank entries up to that day (LATE), with no amount
    (EMPTY), with an amount on the difference account (DIFFERENCE) or with a line that has both sides or a negative one (SIDES)."""
    some = typed.filter("debit <> 0 or credit <> 0")
    sums = typed.select("entity_id").distinct().join(
        some.groupBy("entity_id").agg(total(F.col("credit") - F.col("debit")).alias("difference"), F.max(F.col("account") == DIFFERENCE).alias("_typed"), F.max((F.least("debit", "credit") != 0) | (F.greatest("debit", "credit") <= 0)).alias("_sides")), "entity_id", "left"
    )
    books = lines.groupBy("entity_id").agg(F.min(F.when(F.col("entry_kind") == "BANK", F.col("day"))).alias("_first"), F.max(F.col("entry_kind") == "OPENING").alias("_open"))
    reason = (
        F.when(F.coalesce("_open", F.lit(False)), "AGAIN")
        .when(F.col("_first") <= date(on), "LATE")
        .when(F.col("difference").isNull(), "EMPTY")
        .when(F.col("_typed"), "DIFFERENCE")
        .when(F.col("_sides"), "SIDES")
    )
    heads = sums.join(books, "entity_id", "left").select("entity_id", F.coalesce("difference", F.lit(0)).alias("difference"), reason.alias("reason"))
    fine = heads.filter("reason is null")
    rest = fine.filter("difference <> 0").select(
        "entity_id", F.lit(DIFFERENCE).alias("account"), F.greatest("difference", F.lit(0)).alias("debit"), F.greatest(-F.col("difference"), F.lit(0)).alias("credit")
    )
    rows = some.join(fine.select("entity_id"), "entity_id", "left_semi").select("entity_id", "account", "debit", "credit").unionByName(rest)
    return rows.withColumn("day", date(on)), heads


def opening_bridge(lines: DataFrame, chart: DataFrame, anchor: str, held: tuple[str, ...] = ("1999", "1199")) -> DataFrame:
    """What an entity's books moved up to the anchor, reversed on the day before its first entry, the
    result of that span on retained earnings. An entity whose suspense or clearing accounts (``held``) have a
    balance then is left out, as the bridge would hide it. Accounts that the chart lacks keep their own line."""
    sums = lines.filter(F.col("day") <= date(anchor)).groupBy("entity_id", "account").agg(total(F.col("debit") - F.col("credit")).alias("net"), F.min("day").alias("_first"))
    moved = sums.join(F.broadcast(chart.select("account", "type")), "account", "left")  # a fixed list
    by_entity = Window.partitionBy("entity_id")
    moved = moved.withColumn("_blocked", F.max(F.col("account").isin(*held) & (F.col("net") != 0)).over(by_entity))
    moved = moved.withColumn("day", F.date_sub(F.min("_first").over(by_entity), 1)).filter("not _blocked")
    account = F.when(F.col("type").isin("INCOME", "EXPENSE"), RETAINED).otherwise(F.col("account"))
    rows = moved.groupBy("entity_id", "day", account.alias("account")).agg(total("net").alias("net")).filter("net <> 0")
    return rows.select("entity_id", "day", "account", F.greatest(-F.col("net"), F.lit(0)).alias("debit"), F.greatest("net", F.lit(0)).alias("credit"))


def proved_days(rows: DataFrame) -> DataFrame:
    """Per bank_account and day: n, proved, closing (of the one row that no other follows; else null).

    A day is proved if its rows (amount, balance) make one chain: no balance is missing or twice before or
    behind a row, one row ends it and all hang together. A day of one account is a group of a task."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("bank_account", "day", "amount", "balance").groupBy("bank_account", "day").applyInPandas(_chain, f"bank_account {types['bank_account']}, day date, n long, proved boolean, closing long")


def _chain(pdf):
    import pandas as pd

    head = pdf.iloc[0]
    balances = [None if pd.isna(b) else int(b) for b in pdf["balance"]]
    closing, proved = None, False
    if None not in balances:
        into = {b: b - int(a) for b, a in zip(balances, pdf["amount"])}
        befores = set(into.values())
        ends = [b for b in into if b not in befores]
        if len(into) == len(pdf) == len(befores) and len(ends) == 1:
            at, seen = ends[0], 0
            closing = at
            while at in into and seen <= len(into):
                at, seen = into[at], seen + 1
            proved = seen == len(into)
    return pd.DataFrame({"bank_account": [head["bank_account"]], "day": [head["day"]], "n": [len(pdf)], "proved": [proved], "closing": pd.array([closing], dtype="Int64")})


def receipts_and_revenue(bank: DataFrame, lines: DataFrame, chart: DataFrame, year: int, month: int, months: int = 12, parts: DataFrame | None = None) -> DataFrame:
    """Per entity and month of the last ``months``, none before its first bank line: money in, by what
    it was posted to, the revenue, and operating receipts per thousand of it.

    ``bank``: line_id, entity_id, day, amount (signed), account, status. A receipt in review (NEEDS_REVIEW), without an
    account or on suspense is unclassified, all its parts included. ``parts``: line_id, account, amount of lines that are split."""
    last = year * 12 + month - 1
    index = lambda day: (F.year(day) * 12 + F.month(day) - 1).cast("int")
    kinds = F.broadcast(chart.select("account", "type", "fs_line"))  # a fixed list
    bank = bank.withColumn("index", index("day"))
    first = bank.groupBy("entity_id").agg(F.min("index").alias("_first"))
    money = bank.filter("amount > 0").filter(F.col("index").between(last - months + 1, last))
    sums = money.groupBy("entity_id", "index").agg(total("amount").alias("money_in"))
    if parts is not None:
        split = parts.select("line_id", F.col("account").alias("_account"), F.col("amount").alias("_amount"))
        money = money.join(split, "line_id", "left").withColumn("account", F.when(F.col("_amount").isNotNull(), F.col("_account")).otherwise(F.col("account")))
        money = money.withColumn("amount", F.coalesce("_amount", "amount"))
    part = (
        F.when((F.col("status") == "NEEDS_REVIEW") | F.col("account").isNull() | (F.col("account") == "1999"), "unclassified")
        .when(F.col("account").isin("1199", "1190"), "transfers")
        .when(F.col("type").isin("LIABILITY", "EQUITY"), "financing")
        .otherwise("operating")
    )
    names = ("transfers", "financing", "unclassified", "operating")
    pieces = money.join(kinds, "account", "left").withColumn("_part", part)
    pieces = pieces.groupBy("entity_id", "index").agg(*[total(F.when(F.col("_part") == n, F.col("amount")).otherwise(0)).alias(n) for n in names])
    sold = lines.join(kinds.filter("fs_line = 'REVENUE'"), "account", "left_semi").withColumn("index", index("day")).filter(F.col("index").between(last - months + 1, last))
    sold = sold.groupBy("entity_id", "index").agg(total(F.col("credit") - F.col("debit")).alias("revenue"))
    frame = first.withColumn("index", F.explode(F.sequence(F.lit(last - months + 1), F.lit(last)))).filter("index >= _first").drop("_first")
    rows = frame.join(sums, ["entity_id", "index"], "left").join(pieces, ["entity_id", "index"], "left").join(sold, ["entity_id", "index"], "left").fillna(0)
    ratio = F.when(F.col("revenue") > 0, F.expr("operating * 1000 div greatest(revenue, 1L)"))
    return rows.select("entity_id", F.expr("cast(index div 12 as int)").alias("year"), (F.col("index") % 12 + 1).alias("month"), "money_in", *names, "revenue", ratio.alias("ratio"))


def named_top(rows: DataFrame, keys: list[str], value: str, label: str, k: int) -> DataFrame:
    """K2: the k largest of each key by absolute value, ties by label, as a text, with how many there are more."""
    order = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), label)
    rows = rows.withColumn("_nth", F.row_number().over(order))
    picked = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_nth") <= k, F.struct("_nth", F.concat(F.col(label).cast("string"), F.lit(" "), F.col(value).cast("string")).alias("text"))))).alias("_top"),
        F.count("*").alias("n"),
    )
    text = F.array_join(F.transform("_top", lambda x: x["text"]), ", ")
    more = F.when(F.col("n") > k, F.concat(F.lit(", and "), (F.col("n") - k).cast("string"), F.lit(" more"))).otherwise("")
    return picked.select(*keys, "n", F.concat(text, more).alias("detail"))
