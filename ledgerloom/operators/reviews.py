"""Reviews of bank lines, reporting periods and references to the rows of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import fiscal_year_start, month_start
from ..functions.text import FINANCING, FINANCING_COST
from .ledger import date

#: An answer of a model below it is a guess.
GUESS_PERCENT = 60


def by_part(lines: DataFrame) -> DataFrame:
    """A bank line as one row for each of its ``parts`` (an array of account and amount, unsigned),
    with the part's account and the line's sign; a line without parts as it is."""
    rows = lines.withColumn("_p", F.explode_outer("parts"))
    signed = F.when(F.col("amount") < 0, -F.col("_p.amount")).otherwise(F.col("_p.amount"))
    return rows.withColumn("account", F.coalesce("_p.account", "account")).withColumn("amount", F.coalesce(signed, "amount")).drop("_p", "parts")


def flagged_lines(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """Posted and reviewed lines with words of financing on an account of the income statement, by
    part, and guesses that were accepted as they were."""
    held = lines.filter("status in ('POSTED', 'REVIEWED') and account is not null")
    result = F.broadcast(chart.filter("type in ('INCOME', 'EXPENSE')").select("account"))
    words = F.col("description").rlike(FINANCING) & ~F.col("description").rlike(FINANCING_COST)
    out = ["client_id", "entity_id", "line_id", "day", "account", "amount"]
    financing = by_part(held.filter(words)).join(result, "account", "left_semi").select(F.lit("FINANCING").alias("flag"), *out)
    guessed = (F.col("method") == "HEURISTIC") | ((F.col("method") == "AI") & (F.col("confidence_pct") < GUESS_PERCENT))
    guesses = held.filter((F.col("status") == "REVIEWED") & guessed).select(F.lit("GUESS").alias("flag"), *out)
    return financing.unionByName(guesses)


def in_force(asked: DataFrame, settings: DataFrame, key: str, value: str) -> DataFrame:
    """The latest setting of each asked month, null before the first. ``settings``: key,
    effective_month, value. One ordered stream of both by key."""
    both = asked.select(key, "month", F.lit(1).alias("_asked"), F.lit(None).alias("_value"), F.lit(None).cast("int").alias("_from")).unionByName(
        settings.select(key, F.col("effective_month").alias("month"), F.lit(0).alias("_asked"), F.col(value).alias("_value"), F.col("effective_month").alias("_from"))
    )
    w = Window.partitionBy(key).orderBy("month", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.select(key, "month", "_asked", F.last("_value", ignorenulls=True).over(w).alias(value), F.last("_from", ignorenulls=True).over(w).alias("effective_month"))
    return rows.filter("_asked = 1").drop("_asked")


def report_periods(lines: DataFrame, as_of: str, end_month: int = 12) -> DataFrame:
    """What the reports of an entity cover at a month's end, and what they may compare with: the
    balance of the last year's end or else an opening inside the year, and the same months last year.

    An opening that nothing precedes starts the books on the next day. One aggregate of the lines."""
    at = date(as_of)
    start = fiscal_year_start(at, end_month)
    last_end, prior_start, prior_end = F.date_sub(start, 1), F.add_months(start, -12), F.last_day(F.add_months(at, -12))
    opening = (F.col("entry_kind") == "OPENING") & F.col("day").between(last_end, at)
    sums = lines.groupBy("client_id", "entity_id").agg(
        F.min("day").alias("first_day"), F.min(F.when(opening, F.col("day"))).alias("opening_at"), F.max(F.col("day").between(prior_start, prior_end)).alias("has_prior")
    )
    opens = F.col("opening_at").isNotNull() & (F.col("opening_at") >= start) & (F.col("first_day") >= F.col("opening_at"))
    books = F.when(opens, F.date_add("opening_at", 1)).otherwise(start)
    had = F.col("first_day") <= last_end
    inside = (F.col("opening_at") > last_end) & (F.col("opening_at") < at)
    return sums.select(
        "client_id",
        "entity_id",
        start.alias("year_start"),
        books.alias("books_start"),
        F.when(books > at, start).otherwise(books).alias("from_day"),
        "opening_at",
        F.when(had, last_end).when(inside, F.col("opening_at")).alias("compared_balance"),
        F.when(had, F.coalesce(F.col("opening_at") == last_end, F.lit(False))).when(inside, True).alias("compared_opening"),
        F.when(F.col("has_prior"), prior_start).alias("prior_start"),
        F.when(F.col("has_prior"), prior_end).alias("prior_end"),
    )


def row_references(rows: DataFrame, key: str, longest: int = 500) -> DataFrame:
    """The cells that an entry came from as text: runs of rows by column, columns as they first appear.

    ``rows``: key, sheet, cell ("A5" or "5"), position. The text ends at ``longest`` characters; a run has
    two of them at least, so runs behind the ``longest``-th can't show and aren't collected."""
    kept = rows.select(key, "sheet", "position", F.regexp_extract("cell", r"^([A-Z]*)\d+$", 1).alias("_c"), F.regexp_extract("cell", r"^[A-Z]*(\d+)$", 1).try_cast("long").alias("_n")).repartition(key)
    kept = kept.withColumn("_island", F.col("_n") - F.row_number().over(Window.partitionBy(key, "_c").orderBy("_n")))
    # cells without a row are a run of their own, which only tells the sheet
    first = F.struct(F.col("position").isNotNull(), "position", "sheet")
    runs = kept.groupBy(key, "_c", "_island").agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"), F.min("position").alias("_at"), F.min(first).alias("_first"))
    runs = runs.withColumn("_sheet", F.min("_first").over(Window.partitionBy(key))["sheet"]).drop("_first").filter("lo is not null")
    runs = runs.withColumn("_at", F.min("_at").over(Window.partitionBy(key, "_c")))
    runs = runs.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_at", "lo", "hi"))).filter(F.col("_rank") <= longest)
    text = F.concat("_c", "lo", F.when(F.col("hi") > F.col("lo"), F.concat(F.lit("-"), "hi")).otherwise(""))
    lists = runs.groupBy(key, "_sheet").agg(F.array_sort(F.collect_list(F.struct("_rank", text.alias("text")))).alias("_runs"))
    return lists.select(key, F.substring(F.concat("_sheet", F.lit("!"), F.array_join("_runs.text", ",")), 1, longest).alias("reference"))


def natural_key(code) -> Column:
    """K5: a key under which codes sort with their numbers as numbers."""
    runs = F.regexp_extract_all(code, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 18, "0")).otherwise(r)), "")


def probe(rows: DataFrame, most: int = 200) -> DataFrame:
    """K6: how many rows there are up to ``most``, and whether there are more; reads one row beyond."""
    return rows.limit(most + 1).agg(F.least(F.count("*"), F.lit(most)).alias("n"), (F.count("*") > most).alias("more"))


def asset_balances(movements: DataFrame) -> DataFrame:
    """Cost and depreciation summed up along an asset's movements."""
    w = Window.partitionBy("asset_id").orderBy("day", "movement_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = movements.withColumn("cost_to_date", F.sum("cost").over(w)).withColumn("depreciation_to_date", F.sum("depreciation").over(w))
    return rows.withColumn("book_value", F.col("cost_to_date") - F.col("depreciation_to_date"))


def counted_controls(entities: DataFrame, findings: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Checks that count what breaks them. ``findings``: key, severity, rows with entity_id and
    maybe their number ``n``; every entity (client_id, entity_id) gets a row by check."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("check_key"), F.lit(s).alias("_severity")) for k, s, _ in findings]))
    found = None
    for k, _, rows in findings:
        one = rows.groupBy("entity_id").agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("n")).withColumn("check_key", F.lit(k))
        found = one if found is None else found.unionByName(one)
    cells = entities.select("client_id", "entity_id", keys.alias("_k")).select("client_id", "entity_id", "_k.*")
    cells = cells.join(found, ["entity_id", "check_key"], "left").fillna(0, ["n"])
    return cells.select("client_id", "entity_id", "check_key", F.when(F.col("n") > 0, F.col("_severity")).otherwise("PASS").alias("status"), "n")


def empty_months(lines: DataFrame, month: int) -> DataFrame:
    """Entities with lines before a month and none in it."""
    at = month_start(F.lit(month))
    end = F.last_day(at)
    sums = lines.filter(F.col("day") <= end).groupBy("entity_id").agg(F.max("day").alias("last"))
    return sums.filter(F.col("last") < at).select("entity_id")
