"""Open items, aging, loss allowances, settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket, month_end, month_index
from ..functions.money import half_up
from ..functions.text import NO_NAMES, plain_words
from .ledger import date, total

BUCKETS = ["CURRENT", "D1_30", "D31_60", "D61_90", "OVER_90"]
PPM = 1_000_000


def open_items(invoices: DataFrame, settlements: DataFrame, as_of: str) -> DataFrame:
    """Invoices issued by a date less what was settled by then, with days past due and bucket."""
    issued = invoices.filter(F.col("issue_date") <= date(as_of))
    settled = settlements.filter(F.col("paid_on") <= date(as_of)).groupBy("invoice_id").agg(total("amount").alias("settled"))
    rows = issued.join(settled, "invoice_id", "left").withColumn("settled", F.coalesce("settled", F.lit(0)).cast("long"))
    days = F.date_diff(date(as_of), "due_date")
    return rows.select("*", (F.col("total") - F.col("settled")).alias("open"), days.alias("days_past_due"), bucket(days).alias("bucket"))


def aging_by_contact(items: DataFrame) -> DataFrame:
    """Positive open amounts by contact and bucket."""
    rows = items.filter("open > 0").groupBy("client_id", "contact_id")
    return rows.agg(*[total(F.when(F.col("bucket") == b, F.col("open"))).alias(b.lower()) for b in BUCKETS], total("open").alias("total"), F.count("*").alias("n_items"))


def unallocated(settlements: DataFrame, invoices: DataFrame, as_of: str) -> DataFrame:
    """What was paid on items beyond their amount, by contact."""
    items = open_items(invoices, settlements, as_of).filter("open < 0")
    return items.groupBy("client_id", "contact_id").agg(total(-F.col("open")).alias("free"), F.count("*").alias("n_items"))


def subledger_proof(lines: DataFrame, items: DataFrame, account: str, as_of: str) -> DataFrame:
    """Open items against the account's balance, by entity."""
    book = lines.filter((F.col("account") == account) & (F.col("day") <= date(as_of))).groupBy("entity_id").agg(total(F.col("debit") - F.col("credit")).alias("ledger"))
    own = items.groupBy("entity_id").agg(total("open").alias("subledger"))
    rows = own.join(book, "entity_id", "full_outer").fillna(0, ["ledger", "subledger"])
    return rows.withColumn("difference", F.col("subledger") - F.col("ledger"))


def sales_by_channel(invoices: DataFrame, month: str) -> DataFrame:
    """The month's and the year's sales by channel; those without a channel come last."""
    m = month_index(date(month))
    at = month_index("issue_date")
    rows = invoices.filter(at.between(m - F.month(date(month)) + 1, m)).groupBy("client_id", F.coalesce("channel", F.lit("NONE")).alias("channel"))
    return rows.agg(total(F.when(at == m, F.col("total"))).alias("month_sales"), total("total").alias("year_sales"), F.count("*").alias("n_invoices"))


def receivables_view(items: DataFrame, contacts: DataFrame) -> DataFrame:
    """Aging totals with contacts that hold only an advance; net is total less advance."""
    aging = items.filter("open > 0").groupBy("contact_id").agg(total("open").alias("total"))
    advances = contacts.filter("advance > 0").select("contact_id", "advance")
    rows = aging.join(advances, "contact_id", "full_outer").fillna(0, ["total", "advance"])
    return rows.withColumn("net", F.col("total") - F.col("advance"))


def open_at_month_ends(invoices: DataFrame, settlements: DataFrame, end_month: str, months: int) -> DataFrame:
    """client_id, invoice_id, month, open, bucket at each of the last month ends."""
    last = month_index(date(end_month))
    at = F.explode(F.sequence(last - months, last))
    rows = invoices.withColumn("month", at).filter(F.col("issue_date") <= month_end("month"))
    # amounts move to the month end they first count at, then run on: no join of payments with months
    paid = settlements.groupBy("invoice_id", F.greatest(month_index("paid_on"), last - months).alias("month")).agg(total("amount").alias("paid"))
    running = Window.partitionBy("invoice_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(paid, ["invoice_id", "month"], "left")
    rows = rows.withColumn("settled", F.coalesce(F.sum("paid").over(running), F.lit(0)))
    return rows.select("client_id", "invoice_id", "month", (F.col("total") - F.col("settled")).alias("open"), bucket(F.date_diff(month_end("month"), "due_date")).alias("bucket"))


def roll_rates(invoices: DataFrame, settlements: DataFrame, end_month: str, months: int = 12) -> DataFrame:
    """By bucket, of what was open in it at a month end and has aged past it at the next, the
    share still open then, in parts per million half up, and the mean over the months with a base."""
    states = open_at_month_ends(invoices, settlements, end_month, months)
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    after = Window.partitionBy("invoice_id").orderBy("month")
    states = states.withColumn("rank", rank)
    rows = states.withColumn("later", F.lead("open").over(after)).withColumn("later_rank", F.lead("rank").over(after))
    rows = rows.filter("open > 0 and later is not null and later_rank > rank")
    by_month = rows.groupBy("client_id", "bucket", "month").agg(total("open").alias("base"), total(F.greatest(F.lit(0), F.least("open", "later"))).alias("rolled"))
    by_month = by_month.withColumn("ppm", half_up(F.col("rolled").cast("decimal(19,0)") * PPM, "base"))
    return by_month.groupBy("client_id", F.col("bucket").alias("from_bucket")).agg(half_up(F.sum("ppm"), F.count("*")).alias("ppm"), F.count("*").alias("samples"))


def loss_rates(rolls: DataFrame, last_ppm: int = PPM) -> DataFrame:
    """The last bucket's rate is set, an earlier one's is its roll rate times the next; zero
    stops the chain, an unknown roll rate leaves it and what depends on it unknown."""
    wide = rolls.groupBy("client_id").agg(*[F.max(F.when(F.col("from_bucket") == b, F.col("ppm"))).alias(f"_{b}") for b in BUCKETS[:-1]])
    rate = F.lit(last_ppm).cast("long")
    out = [F.struct(F.lit(BUCKETS[-1]).alias("bucket"), rate.alias("loss_ppm"))]
    for b in reversed(BUCKETS[:-1]):
        roll = F.col(f"_{b}")
        rate = F.when(roll == 0, F.lit(0).cast("long")).otherwise(half_up(roll * rate, PPM))
        out.append(F.struct(F.lit(b).alias("bucket"), rate.alias("loss_ppm")))
    return wide.select("client_id", F.inline(F.array(*out)))


def allowance(items: DataFrame, rates: DataFrame, forward_bp: int = 10_000) -> DataFrame:
    """Open amount times loss rate times the forward-looking factor, half up; unknown where the
    rate is and something is open."""
    opened = items.filter("open > 0").groupBy("client_id", "bucket").agg(total("open").alias("open"))
    rows = rates.join(opened, ["client_id", "bucket"], "left").fillna(0, ["open"])
    product = F.col("open").cast("decimal(18,0)") * F.col("loss_ppm").cast("decimal(7,0)") * F.lit(forward_bp)
    value = F.when(F.col("loss_ppm").isNull(), F.when(F.col("open") > 0, F.lit(None)).otherwise(F.lit(0))).otherwise(half_up(product, PPM * 10_000))
    return rows.select("client_id", "bucket", "open", "loss_ppm", value.cast("long").alias("allowance"))


def fifo_allocation(receipts: DataFrame, invoices: DataFrame) -> DataFrame:
    """One receipt per contact over its open invoices, oldest due first."""
    order = Window.partitionBy("contact_id").orderBy("due_date", "invoice_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = invoices.filter("total > 0").join(receipts, "contact_id").withColumn("_cum", F.sum("total").over(order))
    cash = F.greatest(F.lit(0), F.least(F.col("total"), F.col("receipt") - F.col("_cum") + F.col("total")))
    return rows.select("contact_id", "invoice_id", "total", cash.cast("long").alias("allocated")).filter("allocated > 0")


def aging_file_difference(items: DataFrame, contacts: DataFrame, listed: DataFrame) -> DataFrame:
    """A counterparty list (key, amount) against the own open items by normalised name."""
    from ..functions.text import normal_name

    own = items.filter("open > 0").join(contacts.select("contact_id", normal_name("contact_name").alias("key")), "contact_id").groupBy("key").agg(total("open").alias("own"))
    rows = own.join(listed, "key", "full_outer").fillna(0, ["own", "amount"])
    return rows.withColumn("difference", F.col("own") - F.col("amount")).filter("difference <> 0")


def cut_off_candidates(lines: DataFrame, account: str, as_of: str, days: int = 7, k: int = 20) -> DataFrame:
    """The largest entries on an account around a date (a top-k report)."""
    rows = lines.filter((F.col("account") == account) & F.col("day").between(F.date_sub(date(as_of), days), F.date_add(date(as_of), days)))
    rows = rows.groupBy("entry_id", "day").agg(total(F.col("debit") - F.col("credit")).alias("amount"))
    return rows.orderBy(F.abs("amount").desc(), "entry_id").limit(k)


def rarest_words(contacts: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """The word of each contact's ``_name`` that the fewest receipts of its key hold, of names whose words are all held by some."""
    held = contacts.select("*", F.explode("_name").alias("word")).join(words.groupBy(*key, "word").agg(F.count("*").alias("_n")), [*key, "word"])
    found = held.groupBy(*key, "item_contact_id", "_name").agg(F.min_by("word", F.struct("_n", "word")).alias("word"), F.count("*").alias("_held"))
    return found.filter(F.col("_held") == F.size("_name")).drop("_held")


def settlement_candidates(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """All open items of a receipt's entity and direction that it could settle, ranked per receipt.

    receipts: receipt_id, entity_id, direction, day, receipt (what is free of it), contact_id, account
    (null while in review), description. items: invoice_id, entity_id, direction, contact_id,
    contact_name, number, account, issue_date (null for an opening item), due_date, open, expected_tax.
    An item is a candidate if it is of the receipt's contact, if its open amount or that less the tax the
    payer withholds is the receipt, or if the description names its contact or number; one of another
    contact must be issued by the receipt's day. The caller leaves out receipts of locked months. Each
    condition is a join on equal keys; a name is looked up by its word that the fewest receipts hold, and not at all
    if no receipt holds one of its words.

    Receipts meet contacts first, and these their items; what amounts and numbers find is only what
    contacts haven't. So no pair is found twice, and pairs move once, to their receipt's ranks."""
    key = ["entity_id", "direction"]
    flag = lambda c: F.coalesce(c, F.lit(False))
    receipts = receipts.filter("receipt > 0").select(*key, "receipt_id", "contact_id", "receipt", "day", "account", plain_words("description").alias("_text"))
    tax = F.coalesce("expected_tax", F.lit(0))
    named = F.filter(F.split(plain_words("contact_name"), " "), lambda w: (F.length(w) >= 3) & ~w.isin(NO_NAMES))
    items = items.filter("open > 0").select(
        *key, "invoice_id", F.col("contact_id").alias("item_contact_id"), F.col("account").alias("item_account"), "issue_date", "due_date", "open",
        F.when(tax > 0, F.col("open") - tax).otherwise(F.col("open")).alias("_net"),
        F.coalesce(F.array_distinct(named), F.array().cast("array<string>")).alias("_name"), plain_words("number").alias("_number"),
    )
    same = flag(F.col("contact_id") == F.col("item_contact_id"))
    by_name = flag((F.size("_name") > 0) & (F.size(F.array_except("_name", F.split("_text", " "))) == 0))
    exact = flag(F.col("receipt").isin(F.col("open"), F.col("_net")))
    says = flag(F.contains(F.concat(F.lit(" "), "_text", F.lit(" ")), F.concat(F.lit(" "), "_number", F.lit(" "))) & (F.length("_number") >= 3))

    words = receipts.select("*", F.explode(F.array_distinct(F.split("_text", " "))).alias("word")).filter("word <> ''")
    contacts = items.select(*key, "item_contact_id", "_name").distinct()
    rare = rarest_words(contacts, words, key)
    own = receipts.join(contacts.withColumn("contact_id", F.col("item_contact_id")), [*key, "contact_id"]).withColumn("_named", by_name)
    met = own.unionByName(words.join(rare, [*key, "word"]).filter(by_name & ~same).drop("word").withColumn("_named", F.lit(True)))
    who = F.struct("item_contact_id")  # a contact that is null is one, too
    of_contacts = met.withColumn("_who", who).drop("item_contact_id").join(items.withColumn("_who", who), [*key, "_who", "_name"]).drop("_who")
    amounts = items.select("*", F.explode(F.array_distinct(F.array("open", "_net"))).alias("receipt"))
    by_amount = receipts.join(amounts, [*key, "receipt"]).filter(~same & ~by_name)
    first = items.filter(F.length("_number") >= 3).withColumn("word", F.substring_index("_number", " ", 1))
    by_number = words.join(first, [*key, "word"]).filter(says & ~same & ~by_name & ~exact).drop("word")
    rows = of_contacts.unionByName(by_amount.unionByName(by_number).withColumn("_named", F.lit(False)))

    rows = rows.select(
        "receipt_id", "contact_id", "receipt", "invoice_id", "item_contact_id", "open", "due_date", "issue_date", "day",
        same.alias("same_contact"), exact.alias("exact"), (F.col("_named") | says).alias("named"),
        flag(F.col("account") == F.col("item_account")).alias("on_account"),
        F.when(F.col("open") == F.col("receipt"), 2).when(F.col("open") > F.col("receipt"), 1).otherwise(0).alias("score"),
    )
    rows = rows.filter("same_contact or ((exact or named) and (issue_date is null or issue_date <= day))").drop("issue_date", "day")
    both = F.col("exact") & F.col("named")
    order = Window.partitionBy("receipt_id").orderBy(F.desc("same_contact"), both.desc(), F.desc("exact"), F.desc("named"), F.desc("on_account"), F.desc("score"), "due_date", "invoice_id")
    return rows.select("receipt_id", "contact_id", "receipt", "invoice_id", "item_contact_id", "open", "same_contact", "exact", "named", "score", F.row_number().over(order).alias("rank"))
