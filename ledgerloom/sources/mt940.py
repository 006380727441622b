"""Statements of SWIFT MT940 files, read and proven.

A file is refused for its first fault, as a statement that doesn't add up must not be booked in part. Faults are
those of a tag in its place (in the order of the file), then of a message by itself, then of an account's messages
in a row. What a tag may be depends on the tags of its message before it, so all of it is windows over a file's
lines; a window streams, it holds no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The header blocks of a message, a balance, a movement, a page.
ENVELOPE = r"^(\{[1-3]:([^{}]|\{[^{}]*\})*\})+"
BALANCE = r"^([CD])(\d{6})([A-Z]{3})(\d+(,\d*)?)$"
MOVEMENT = r"^(\d{6})(\d{4})?(RC|RD|C|D)([A-Z])?(\d+,\d*)([NSF][A-Z0-9]{3})(.*)$"
PAGE = r"^\d{1,5}(/\d{1,5})?$"
EXACT = "decimal(38,10)"


def tags(lines: DataFrame) -> DataFrame:
    """file, line_no, tag, value (with its further lines), message (how many :20: came before or here).

    ``lines``: file, line_no, text. Header blocks, trailers and what comes before the first tag go."""
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), r"[\r\s]+$", "")
    text = F.regexp_replace(F.regexp_replace(text, ENVELOPE, ""), r"^\{4:", "")
    rows = lines.select("file", "line_no", text.alias("text")).filter(r"text <> '' and not text rlike '^-\\}?(\\{5:.*)?$' and not text rlike '^\\{5:'")
    head = r"^:(\d{2}[A-Z]?):(.*)$"
    order = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("tag", F.nullif(F.regexp_extract("text", head, 1), F.lit("")))
    rows = rows.withColumn("n", F.count("tag").over(order)).withColumn("message", F.count(F.when(F.col("tag") == "20", 1)).over(order)).filter("n > 0")
    part = F.when(F.col("tag").isNotNull(), F.regexp_extract("text", head, 2)).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", part.alias("part"))))
    grouped = rows.groupBy("file", "message", "n").agg(F.min("line_no").alias("line_no"), F.max("tag").alias("tag"), F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("value"))
    return grouped.drop("n")


def _day(text: Column) -> Column:
    """The day of yymmdd in this century, null if the calendar lacks it."""
    return F.try_to_timestamp(F.concat(F.lit("20"), text), F.lit("yyyyMMdd")).cast("date")


def _exact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ",$", ""), ",", ".").try_cast(EXACT)


def _cents(exact: Column) -> Column:
    return F.round(exact * 100).cast("long")


def account_number(raw: Column) -> Column:
    """The number behind a bank's code, a currency and blanks."""
    tail = F.trim(F.substring_index(raw, "/", -1))
    digits = F.regexp_replace(tail, r"[\s.-]", "")
    return F.when(digits.rlike(r"^\d{6,}$"), digits).otherwise(F.regexp_replace(F.regexp_replace(tail, r"^[A-Z]{3}(?=\d)", ""), r"\s+", ""))


def read(lines: DataFrame) -> DataFrame:
    """Tags with what they say: ``account``, ``page``, ``balance`` (sign, day, currency), ``move``, and ``fault``, the one of the tag in its place.

    A fault is right up to the first of its file; what comes behind it may be said of a state that was never reached."""
    rows = tags(lines)
    squeezed = F.regexp_replace(F.element_at(F.split("value", "\n"), 1), r"\s+", "")
    whole = F.regexp_replace("value", r"\s+", "")
    of = lambda text, pattern, k: F.regexp_extract(text, pattern, k)
    is_open, is_close = F.col("tag").isin("60F", "60M"), F.col("tag").isin("62F", "62M")
    is_page = F.col("tag").isin("28", "28C")
    account = F.when(F.col("tag") == "25", F.nullif(F.trim(F.element_at(F.split("value", "\n"), 1)), F.lit("")))
    page = F.when(is_page, F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")))
    exact = _exact(of(whole, BALANCE, 4))
    balance = F.struct(F.when(of(whole, BALANCE, 1) == "D", -exact).otherwise(exact).alias("exact"), _day(of(whole, BALANCE, 2)).alias("day"), of(whole, BALANCE, 3).alias("currency"), whole.rlike(BALANCE).alias("fits"))
    amount = _exact(of(squeezed, MOVEMENT, 5))
    value, booked = _day(of(squeezed, MOVEMENT, 1)), of(squeezed, MOVEMENT, 2)
    month = of(squeezed, MOVEMENT, 1).substr(3, 2)
    # a booking date has no year: it is the value date's, or the next or last one across the turn of a year
    turn = F.when((booked.substr(1, 2) == "01") & (month == "12"), 1).when((booked.substr(1, 2) == "12") & (month == "01"), -1).otherwise(0)
    year = F.lpad((of(squeezed, MOVEMENT, 1).substr(1, 2).try_cast("int") + turn).cast("string"), 2, "0")
    day = F.when(value.isNotNull(), F.when(booked == "", value).otherwise(_day(F.concat(year, booked))))
    words = F.concat_ws(" ", F.regexp_replace(F.regexp_replace(of(squeezed, MOVEMENT, 7), "^NONREF", ""), "//", " "), F.when(F.col("value").contains("\n"), F.regexp_replace("value", r"^[^\n]*\n", "")))
    words = F.trim(F.regexp_replace(F.concat(of(squeezed, MOVEMENT, 6).substr(2, 3), F.lit(" "), words), r"\s+", " "))
    move = F.struct(F.when(of(squeezed, MOVEMENT, 3).isin("D", "RC"), -amount).otherwise(amount).alias("exact"), day.alias("day"), words.alias("words"), squeezed.rlike(MOVEMENT).alias("fits"))
    rows = rows.withColumn("account", account).withColumn("page", page).withColumn("balance", F.when(is_open | is_close, balance)).withColumn("move", F.when(F.col("tag") == "61", move))

    message = Window.partitionBy("file", "message").orderBy("line_no")
    earlier = message.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda test: F.count(F.when(test, 1)).over(earlier) > 0
    rows = rows.withColumn("_account", before(F.col("account").isNotNull())).withColumn("_open", before(is_open)).withColumn("_closed", before(is_close))
    rows = rows.withColumn("_paged", before(F.col("page").isNotNull())).withColumn("_currency", F.first(F.when(is_open, F.col("balance.currency")), ignorenulls=True).over(earlier))
    pages = F.split("page", "/")
    unread = F.when(~F.col("balance.fits") | (F.col("balance.exact").isNull() & F.col("balance.day").isNotNull()), "BALANCE_UNREADABLE").when(F.col("balance.day").isNull(), "NO_SUCH_DAY")
    fault = (
        F.when(F.col("account").isNotNull() & F.col("_account"), "ACCOUNT_AGAIN")
        .when(is_page & (F.col("_paged") | F.col("_open")), "PAGE_OUT_OF_PLACE")
        .when(is_page & (~F.col("page").rlike(PAGE) | F.exists(pages, lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) < 1)), "PAGE_INVALID")
        .when(is_open, F.when(F.col("_open"), "OPENING_AGAIN").when(~F.col("_account"), "NO_ACCOUNT").otherwise(unread))
        .when(
            F.col("tag") == "61",
            F.when(~F.col("_open"), "MOVEMENT_BEFORE_OPENING").when(F.col("_closed"), "MOVEMENT_AFTER_CLOSING")
            .when(~F.col("move.fits") | F.col("move.exact").isNull(), "MOVEMENT_UNREADABLE").when(F.col("move.day").isNull(), "NO_SUCH_DAY"),
        )
        .when(is_close, F.when(~F.col("_open"), "CLOSING_WITHOUT_OPENING").otherwise(F.coalesce(unread, F.when(F.col("_closed"), "CLOSING_AGAIN").when(F.col("balance.currency") != F.col("_currency"), "OTHER_CURRENCY"))))
    )
    return rows.withColumn("fault", fault).drop("_account", "_open", "_closed", "_paged", "_currency")


def movements(said: DataFrame) -> DataFrame:
    """file, message, line_no, day, exact, description: each :61: with the last words of the :86: behind it, or its own."""
    order = Window.partitionBy("file", "message").orderBy("line_no")
    # an opening or closing ends what an :86: may belong to
    some = said.filter("tag in ('61', '86', '60F', '60M', '62F', '62M')").withColumn("_at", F.last(F.when(F.col("tag") != "86", F.col("line_no")), ignorenulls=True).over(order))
    text = F.nullif(F.trim(F.regexp_replace("value", r"\s+", " ")), F.lit(""))
    told = some.groupBy("file", "message", "_at").agg(
        F.max("move").alias("move"), F.max_by(text, F.when((F.col("tag") == "86") & text.isNotNull(), F.col("line_no"))).alias("_text")
    )
    return told.filter("move is not null").select("file", "message", F.col("_at").alias("line_no"), "move.day", "move.exact", F.coalesce("_text", "move.words").alias("description"))


def messages(said: DataFrame) -> DataFrame:
    """One row per message that has an opening: account, number, currency, page, tags, balances and days."""
    is_open, is_close = F.col("tag").isin("60F", "60M"), F.col("tag").isin("62F", "62M")
    first = lambda value, test: F.min_by(value, F.when(test, F.col("line_no")))
    rows = said.groupBy("file", "message").agg(
        first(F.col("account"), F.col("account").isNotNull()).alias("account"),
        first(F.col("page"), F.col("page").isNotNull()).alias("page"),
        first(F.struct("tag", "line_no", "balance"), is_open).alias("_open"),
        first(F.struct("tag", "balance"), is_close).alias("_close"),
    )
    return rows.filter("_open is not null").select(
        "file", "message", "page", account_number(F.col("account")).alias("account_number"), F.col("_open.balance.currency").alias("currency"), F.col("_open.line_no").alias("line_no"),
        F.col("_open.tag").alias("open_tag"), F.col("_open.balance.exact").alias("opening"), F.col("_open.balance.day").alias("open_day"),
        F.col("_close.tag").alias("close_tag"), F.col("_close.balance.exact").alias("closing"), F.col("_close.balance.day").alias("close_day"),
    )


def faults(lines: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """file, fault, line_no: the first fault of each file that has one."""
    said = read(lines) if said is None else said
    order = Window.partitionBy("file").orderBy("message")
    # a message without an opening is noticed where the next one begins, or behind the last tag
    heads = said.groupBy("file", "message").agg(F.min("line_no").alias("line_no"), F.max(F.col("tag").isin("60F", "60M")).alias("_opened"))
    cut = heads.withColumn("at", F.coalesce(F.lead("line_no").over(order), F.lit(1 << 62))).filter("message > 0 and not _opened")
    found = said.filter("fault is not null").select("file", F.lit(1).alias("phase"), F.col("line_no").alias("at"), F.lit(0).alias("step"), "fault", "line_no")
    found = found.unionByName(cut.select("file", F.lit(1).alias("phase"), "at", F.lit(0).alias("step"), F.lit("CUT_OFF").alias("fault"), "line_no"))
    none = lines.select("file").distinct().join(said.filter("tag in ('60F', '60M')").select("file").distinct(), "file", "left_anti")
    found = found.unionByName(none.select("file", F.lit(2).alias("phase"), F.lit(-1).cast("long").alias("at"), F.lit(0).alias("step"), F.lit("NO_OPENING").alias("fault"), F.lit(None).cast("long").alias("line_no")))

    blocks = messages(said)
    sums = movements(said).groupBy("file", "message").agg(F.sum("exact").alias("_sum"), F.min("day").alias("_from"), F.max("day").alias("_to"))
    proven = blocks.join(sums, ["file", "message"], "left")
    own = (
        F.when(F.col("closing").isNull(), "NO_CLOSING")
        .when(F.col("close_day") < F.col("open_day"), "CLOSING_BEFORE_OPENING")
        .when((F.col("_from") < F.col("open_day")) | (F.col("_to") > F.col("close_day")), "DAY_OUTSIDE")
        .when(F.col("opening") + F.coalesce("_sum", F.lit(0)) != F.col("closing"), "SUM")
    )
    found = found.unionByName(proven.withColumn("fault", own).filter("fault is not null").select("file", F.lit(2).alias("phase"), F.col("line_no").alias("at"), F.lit(0).alias("step"), "fault", "line_no"))

    chain = Window.partitionBy("file", "account_number", "currency").orderBy("message")
    prev = lambda c: F.lag(c).over(chain)
    every = Window.partitionBy("file", "account_number", "currency")
    rows = blocks.withColumn("_k", F.row_number().over(chain)).withColumn("_group", F.min("line_no").over(every))
    rows = rows.withColumn("_last_tag", F.last("close_tag").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    for c in ("close_day", "close_tag", "closing", "page", "open_day"):
        rows = rows.withColumn(f"_p_{c}", prev(c))
    number = lambda c, k: F.coalesce(F.get(F.split(c, "/"), k).try_cast("int"), F.lit(1))
    page, last = number("page", 1), number("_p_page", 1)
    follows = (number("page", 0) == number("_p_page", 0)) & (page == last + 1)
    begins = (page == 1) & ((number("page", 0) == number("_p_page", 0) + 1) | ((number("page", 0) == 1) & (F.year("open_day") > F.year("_p_open_day"))))
    joint = F.when(
        F.col("_k") == 1,
        F.when((F.col("open_tag") != "60F") | (F.col("_last_tag") != "62F"), "PAGES_INCOMPLETE").when(F.col("page").isNotNull() & (page != 1), "FIRST_PAGE_MISSING"),
    ).otherwise(
        F.when(F.col("open_day") < F.col("_p_close_day"), "DAYS_OUT_OF_ORDER").when(F.col("open_day") > F.col("_p_close_day"), "DAYS_MISSING")
        .when((F.col("_p_close_tag") == "62M") != (F.col("open_tag") == "60M"), "INTERMEDIATE_BALANCE")
        .when(F.col("page").isNotNull() & F.col("_p_page").isNotNull() & ~follows & ~begins, "PAGE_MISSING")
        .when(F.col("opening") != F.col("_p_closing"), "BALANCE_BROKEN")
    )
    late = rows.withColumn("fault", joint).filter("fault is not null").select("file", F.lit(3).alias("phase"), F.col("_group").alias("at"), F.col("_k").alias("step"), "fault", "line_no")
    found = found.unionByName(late)
    return found.groupBy("file").agg(F.min_by(F.struct("fault", "line_no"), F.struct("phase", "at", "step")).alias("_f")).select("file", "_f.fault", "_f.line_no")


def statements(lines: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """One row per account and currency of a file without faults: period, balances (cents), messages and movements."""
    said = read(lines) if said is None else said
    blocks = messages(said).join(faults(lines, said).select("file"), "file", "left_anti")
    moves = movements(said).groupBy("file", "message").agg(F.count("*").alias("n"), F.min("day").alias("first"))
    rows = blocks.join(moves, ["file", "message"], "left").groupBy("file", "account_number", "currency").agg(
        F.min_by(F.struct("open_day", "opening"), "message").alias("_open"), F.max_by(F.struct("close_day", "closing"), "message").alias("_close"),
        F.min("first").alias("_first"), F.count("*").alias("n_messages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )
    start = F.least(F.date_add("_open.open_day", 1), F.col("_first"), F.col("_close.close_day"))
    return rows.select("file", "account_number", "currency", start.alias("period_start"), F.col("_close.close_day").alias("period_end"), _cents(F.col("_open.opening")).alias("opening"), _cents(F.col("_close.closing")).alias("closing"), "n_messages", "n_rows")


def rows(lines: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """file, line_no, account_number, currency, day, description, amount (cents), balance (on a message's last movement) of files without faults."""
    said = read(lines) if said is None else said
    blocks = messages(said).join(faults(lines, said).select("file"), "file", "left_anti").drop("line_no")
    moves = movements(said).join(blocks, ["file", "message"])
    last = F.max("line_no").over(Window.partitionBy("file", "message")) == F.col("line_no")
    return moves.select("file", "line_no", "account_number", "currency", "day", "description", _cents(F.col("exact")).alias("amount"), F.when(last, _cents(F.col("closing"))).alias("balance"))
