"""Post-employment benefits: survival to retirement, obligation and cost, and the journal that books them."""

from __future__ import annotations

import datetime as dt
from calendar import monthrange

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import years_between
from ..functions.money import half_up, let
from .ledger import date, total

# Completed years of service from which so many months of reward are due; months of severance
# rise by one a year up to nine; a benefit is earned over its last 24 years.
REWARD = [(24, 10), (21, 8), (18, 7), (15, 6), (12, 5), (9, 4), (6, 3), (3, 2)]
MOST_SEVERANCE, CAP_YEARS = 9, 24
# Accounts of the liability, the yearly expense and the remeasurement.
LIABILITY, EXPENSE, REMEASUREMENT, RETAINED = "2310", "6105", "3920", "3200"
TENTHS = 1_000_000_000


def severance_months(years: Column) -> Column:
    return F.least(F.lit(MOST_SEVERANCE), F.floor(years) + 1).cast("double")


def reward_months(years: Column) -> Column:
    found = F.lit(0)
    for least, months in reversed(REWARD):
        found = F.when(years >= least, months).otherwise(found)
    return found.cast("double")


def earned(service: Column, exit_: Column, at: float) -> Column:
    """The share of a benefit paid in ``exit_`` years that is earned ``at`` years from now."""
    start = F.greatest(-service, exit_ - CAP_YEARS)
    share = (F.least(F.lit(float(at)), exit_) - start) / F.when(exit_ > start, exit_ - start)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), F.lit(1.0))


def resign_rate(age: Column) -> Column:
    """The yearly rate of leaving: flat up to an age, then falling evenly to none."""
    falling = F.col("resign") * (F.col("zero_age") - age) / (F.col("zero_age") - F.col("flat_until"))
    return F.when(age <= F.col("flat_until"), F.col("resign")).when(age >= F.col("zero_age"), F.lit(0.0)).otherwise(falling)


def times(wage: Column, factor: Column) -> Column:
    """An amount, not negative, times a factor of nine decimals; both are rounded half up."""
    return half_up(wage.cast("decimal(19,0)") * F.floor(factor * TENTHS + 0.5).cast("decimal(18,0)"), TENTHS)


def _factors(age: Column, service: Column) -> Column:
    """Obligation and obligation in a year by unit of wage, folded over the years to retirement.

    Of those alive at the start of a year some die or become disabled in its middle, who are paid then, and some resign; the
    rest reach the next, and at last retirement. The last year may be a part of one."""
    left = F.col("retirement_age") - age
    grow = lambda t: F.pow(1 + F.col("salary"), t)
    discount = lambda t: F.pow(1 + F.col("discount"), -t)
    start = F.struct(F.lit(1.0).alias("alive"), F.lit(0.0).alias("dbo"), F.lit(0.0).alias("next"))

    def year(at, t):
        span = F.least(F.lit(1.0), left - t)
        last = F.size("qx") - 1
        q = F.least(F.lit(1.0), F.get("qx", F.greatest(F.lit(0), F.least(last, F.floor(age + t).cast("int")))) * span)
        return let(F.struct(span.alias("span"), (q * (1 + F.col("disability"))).alias("exits"), (t + span / 2).alias("mid")), lambda x: paid_out(at, t, x["span"], x["exits"], x["mid"]))

    def paid_out(at, t, span, exits, mid):
        paid = service + mid
        value = at["alive"] * exits * (2 * severance_months(paid) + reward_months(paid)) * grow(mid) * discount(mid)
        stay = F.greatest(F.lit(0.0), 1 - exits - resign_rate(age + t) * span)
        sums = lambda v: F.struct((at["alive"] * stay).alias("alive"), (at["dbo"] + v * earned(service, mid, 0)).alias("dbo"), (at["next"] + v * earned(service, mid, 1)).alias("next"))
        return let(value, sums)

    years = F.sequence(F.lit(0), (F.ceil(left) - 1).cast("int"))
    at_end = 1.75 * severance_months(service + left) + reward_months(service + left)
    now = 1.75 * severance_months(service) + reward_months(service)

    def at_last(folded):
        retired = folded["alive"] * at_end * grow(left) * discount(left)
        dbo = folded["dbo"] + retired * earned(service, left, 0)
        then = folded["next"] + retired * earned(service, left, 1)
        return F.struct(dbo.alias("dbo"), (then - dbo).alias("cost"), left.cast("double").alias("years"), (at_end * grow(left)).alias("benefit"))

    due = F.struct(now.alias("dbo"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("years"), now.alias("benefit"))
    return F.when(left <= 0, due).otherwise(let(F.aggregate(years, start, year), at_last))  # folded once


def valued_employees(employees: DataFrame, settings: DataFrame, mortality: DataFrame) -> DataFrame:
    """Employees with age, service, years_to_retirement, benefit_at_retirement, dbo and service_cost.

    ``employees``: employee_id, entity_id, sex, birth, hired, wage, valued_on. ``settings``: entity_id,
    discount, salary, disability and resign (shares a year), retirement_age, flat_until, zero_age. ``mortality``:
    sex, age (from 0, none left out), qx; ages beyond its ends take the rate of the end."""
    rates = mortality.groupBy("sex").agg(F.transform(F.array_sort(F.collect_list(F.struct("age", "qx"))), lambda r: r["qx"]).alias("qx"))
    tasks = employees.sparkSession.sparkContext.defaultParallelism * 4  # the rows are small and their folds are long
    rows = employees.repartition(tasks, "employee_id").join(settings, "entity_id").join(F.broadcast(rates), "sex")  # a row for each sex
    rows = rows.withColumn("age", years_between(F.col("birth"), F.col("valued_on"))).withColumn("service", years_between(F.col("hired"), F.col("valued_on")))
    rows = rows.withColumn("_f", _factors(F.col("age"), F.col("service")))
    return rows.select(
        *employees.columns, "age", "service", F.col("_f.years").alias("years_to_retirement"),
        times(F.col("wage"), F.col("_f.benefit")).alias("benefit_at_retirement"), times(F.col("wage"), F.col("_f.dbo")).alias("dbo"), times(F.col("wage"), F.col("_f.cost")).alias("service_cost"),
    )


def _span(year: int, month: int, end_month: int) -> tuple[dt.date, dt.date, dt.date, int]:
    """The month's end, the financial year's first day, the day before it and the months of the year so far."""
    elapsed = (month - end_month - 1) % 12 + 1
    first = year * 12 + month - elapsed
    start = dt.date(first // 12, first % 12 + 1, 1)
    return dt.date(year, month, monthrange(year, month)[1]), start, start - dt.timedelta(1), elapsed


def valuations(employees: DataFrame, settings: DataFrame, mortality: DataFrame, lines: DataFrame, year: int, month: int, end_month: int = 12) -> DataFrame:
    """By entity the obligation at a month's end, next year's costs, sensitivities to a percent of discount
    and salary, and what the books must move: expense, retained, remeasurement and liability (debits positive).

    ``employees``: employee_id, entity_id, sex, birth, hired, left_on (or null), wage. ``lines``: journal lines
    with entry_kind, of which BENEFIT is the kind that this valuation posts. The year's expense is its share of the opening
    valuation's service and interest cost, and the obligation of those hired since. Without such postings before this year what the books
    lack of the opening obligation belongs to retained earnings; what is left over is remeasurement."""
    at, start, opening, elapsed = _span(year, month, end_month)
    day = lambda d: F.lit(d)
    cases = [("now", at, 0.0, 0.0), ("open", opening, 0.0, 0.0), ("discount_up", at, 0.01, 0.0), ("discount_down", at, -0.01, 0.0), ("salary_up", at, 0.0, 0.01), ("salary_down", at, 0.0, -0.01)]
    case = F.array(*[F.struct(F.lit(n).alias("case"), day(d).alias("valued_on"), F.lit(x).alias("more_discount"), F.lit(y).alias("more_salary")) for n, d, x, y in cases])
    people = employees.join(settings, "entity_id").withColumn("_c", F.explode(case)).select("*", "_c.*")
    people = people.filter((F.col("hired") <= F.col("valued_on")) & (F.col("left_on").isNull() | (F.col("left_on") > F.col("valued_on"))))
    # each case is a setting of its own; a rate doesn't fall below zero
    people = people.withColumn("setting", F.concat_ws(":", "entity_id", F.col("case")))
    shifted = settings.withColumn("_c", F.explode(case)).select("*", "_c.*")
    shifted = shifted.select(
        F.concat_ws(":", "entity_id", "case").alias("entity_id"), F.greatest(F.lit(0.0), F.col("discount") + F.col("more_discount")).alias("discount"),
        F.greatest(F.lit(0.0), F.col("salary") + F.col("more_salary")).alias("salary"), "disability", "resign", "retirement_age", "flat_until", "zero_age",
    )
    people = people.select("employee_id", F.col("entity_id").alias("of"), F.col("setting").alias("entity_id"), "case", "sex", "birth", "hired", "wage", "valued_on")
    valued = valued_employees(people, shifted, mortality)
    of = lambda name, value: total(F.when(F.col("case") == name, F.col(value)).otherwise(0))
    sums = valued.groupBy(F.col("of").alias("entity_id")).agg(
        F.count_if(F.col("case") == "now").alias("n_employees"), of("now", "dbo").alias("dbo"), of("now", "service_cost").alias("service_cost"),
        of("open", "dbo").alias("opening_dbo"), of("open", "service_cost").alias("opening_cost"),
        total(F.when((F.col("case") == "now") & (F.col("hired") > day(opening)), F.col("dbo")).otherwise(0)).alias("hired_dbo"),
        *[of(n, "dbo").alias(n) for n, *_ in cases[2:]],
    )
    net, posted = F.col("debit") - F.col("credit"), F.col("entry_kind") == "BENEFIT"
    when = lambda c: total(F.when(c, net).otherwise(0))
    books = lines.filter(F.col("day") <= day(at)).groupBy("entity_id").agg(
        (-when(F.col("account") == LIABILITY)).alias("liability"),
        (-when((F.col("account") == LIABILITY) & (F.col("day") <= day(opening)))).alias("liability_opening"),
        when((F.col("account") == EXPENSE) & (F.col("day") >= day(start))).alias("expense_booked"),
        when((F.col("account") == RETAINED) & (F.col("day") >= day(start)) & posted).alias("retained_booked"),
        F.coalesce(F.max(posted & (F.col("day") <= day(opening))), F.lit(False)).alias("earlier"),
    )
    rows = settings.select("entity_id", "discount").join(sums, "entity_id", "left").join(books, "entity_id", "left").fillna(0).fillna(False)
    points = F.round(F.col("discount") * 10_000).cast("long")
    interest = lambda dbo, cost: half_up((F.col(dbo) + F.col(cost)).cast("decimal(19,0)") * points.cast("decimal(9,0)"), 10_000)
    rows = rows.withColumn("interest_cost", interest("dbo", "service_cost")).withColumn("opening_interest", interest("opening_dbo", "opening_cost"))
    annual = (F.col("opening_cost") + F.col("opening_interest")).cast("decimal(19,0)")
    rows = rows.withColumn("expense_target", half_up(annual * elapsed, 12) + F.col("hired_dbo"))
    rows = rows.withColumn("retained", F.when(F.col("earlier"), F.lit(0)).otherwise(F.col("opening_dbo") - F.col("liability_opening") - F.col("retained_booked")).cast("long"))
    rows = rows.withColumn("expense", F.col("expense_target") - F.col("expense_booked")).withColumn("_more", F.col("dbo") - F.col("liability"))
    return rows.select(
        "entity_id", "n_employees", "dbo", "service_cost", "interest_cost", "opening_dbo", "opening_cost", "opening_interest", "expense_target", *[n for n, *_ in cases[2:]],
        "expense", "retained", (F.col("_more") - F.col("expense") - F.col("retained")).alias("remeasurement"), (-F.col("_more")).alias("liability"),
    )


def benefit_lines(valued: DataFrame, on: str) -> DataFrame:
    """The lines that book valuations on a day: entity_id, day, account, debit, credit; nothing where nothing moved."""
    legs = F.array(*[F.struct(F.lit(code).alias("account"), F.col(name).alias("amount")) for code, name in ((EXPENSE, "expense"), (RETAINED, "retained"), (REMEASUREMENT, "remeasurement"), (LIABILITY, "liability"))])
    rows = valued.select("entity_id", date(on).alias("day"), F.explode(legs).alias("l")).filter("l.amount <> 0")
    return rows.select("entity_id", "day", "l.account", F.greatest("l.amount", F.lit(0)).alias("debit"), F.greatest(-F.col("l.amount"), F.lit(0)).alias("credit"))
