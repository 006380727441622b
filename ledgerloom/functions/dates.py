"""Dates: months as indexes, fiscal years, business days, due dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import _col, div


def month_index(d) -> Column:
    return (F.year(_col(d)) * 12 + F.month(_col(d)) - 1).cast("int")


def month_start(index) -> Column:
    """The first day of a month index."""
    i = _col(index)
    return F.make_date(div(i, 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1))


def month_end(index) -> Column:
    return F.last_day(month_start(index))


def fiscal_year_start(d, end_month: int = 12) -> Column:
    """The first day of the financial year, which ends with ``end_month``, that holds the date."""
    first = month_index(d) - (F.month(_col(d)) - 1 - end_month + 12) % 12
    return month_start(first)


def months_into_year(d, end_month: int = 12) -> Column:
    """1 for the first month of the financial year."""
    return ((F.month(_col(d)) - 1 - end_month + 12) % 12 + 1).cast("int")


def business_days_apart(a, b) -> Column:
    """Weekdays after the earlier date up to and with the later one, in closed form.

    Of n whole weeks there are 5 n; in the days that are left, Saturdays and Sundays don't count.
    """
    first, last = F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b))
    days = F.date_diff(last, first)
    rest, day = days % 7, F.weekday(first)  # 0 is Monday
    reached = day + rest
    weekend = F.when(day == 6, F.when(rest == 6, 1).otherwise(0)).otherwise(
        F.when(reached >= 6, 2 - F.when(day == 5, 1).otherwise(0)).when(reached == 5, F.when(day == 5, 0).otherwise(1)).otherwise(0)
    )
    return (div(days, 7) * 5 + rest - weekend).cast("int")


def excel_date(serial) -> Column:
    return F.date_add(F.to_date(F.lit("1899-12-30")), _col(serial).cast("int"))


def due_of_month(index, vat: bool) -> Column:
    """The end of the next month for VAT, else the 15th of it."""
    following = month_start(_col(index) + 1)
    return F.last_day(following) if vat else F.date_add(following, 14)


def tax_month(paid_on) -> Column:
    """The month before a payment, as an index."""
    return (month_index(paid_on) - 1).cast("int")


def years_between(a, b) -> Column:
    return F.date_diff(_col(b), _col(a)) / 365.25


def bucket(days_past_due) -> Column:
    d = _col(days_past_due)
    return F.when(d <= 0, "CURRENT").when(d <= 30, "D1_30").when(d <= 60, "D31_60").when(d <= 90, "D61_90").otherwise("OVER_90")


# Month names and short forms that date texts use.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "mei": 5, "jun": 6, "jul": 7, "aug": 8, "agu": 8, "ags": 8,
    "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "des": 12,
}


def parse_date(text, day_first: bool = True) -> Column:
    """A date from day, month and year parts in any usual form; null if it is none."""
    t = F.lower(F.trim(_col(text)))
    iso = F.regexp_extract(t, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 0) != ""
    a = F.regexp_extract(t, r"^(\d{1,4})[-/. ]", 1).try_cast("int")
    middle = F.regexp_extract(t, r"^\d{1,4}[-/. ]+([a-z]+|\d{1,2})[-/. ]", 1)
    c = F.regexp_extract(t, r"^\d{1,4}[-/. ]+(?:[a-z]+|\d{1,2})[-/. ]+(\d{1,4})", 1)
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    word = middle.rlike("[a-z]")
    month = F.when(word, names[F.substring(middle, 1, 3)]).otherwise(F.when(~word, F.nullif(middle, F.lit("")).try_cast("int")))
    last = F.nullif(c, F.lit("")).try_cast("int")
    year = F.when(iso, a).otherwise(F.when(F.length(c) == 2, last + 2000).otherwise(last))
    first_is_day = F.lit(day_first) | word
    day = F.when(iso, last).when(first_is_day, a).otherwise(month)
    month = F.when(iso | first_is_day, month).otherwise(a)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
