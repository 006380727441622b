"""Benefits against a loop over the years of each employee."""

import datetime as dt
import math
import random

from ledgerloom.operators import benefits


def half_up(n, d):
    return (2 * n + d) // (2 * d)


def loop_of_factors(age, service, qx, a):
    """Obligation now and a year on, by the years until each payment."""
    severance = lambda y: min(9, math.floor(y) + 1)
    reward = lambda y: next((m for least, m in ((24, 10), (21, 8), (18, 7), (15, 6), (12, 5), (9, 4), (6, 3), (3, 2)) if y >= least), 0)

    def share(when, at):
        begun = max(-service, when - 24)
        return 1 if when <= begun else min(1, max(0, (min(at, when) - begun) / (when - begun)))

    left = a["retirement_age"] - age
    if left <= 0:
        return 1.75 * severance(service) + reward(service), 0.0, 1.75 * severance(service) + reward(service)
    payments, alive, t = [], 1.0, 0
    while t < left:
        span = min(1, left - t)
        q = min(1, qx[max(0, min(len(qx) - 1, math.floor(age + t)))] * span) * (1 + a["disability"])
        at = age + t
        leave = a["resign"] if at <= a["flat_until"] else 0 if at >= a["zero_age"] else a["resign"] * (a["zero_age"] - at) / (a["zero_age"] - a["flat_until"])
        mid = t + span / 2
        payments.append((mid, alive * q * (2 * severance(service + mid) + reward(service + mid))))
        alive *= max(0, 1 - q - leave * span)
        t += 1
    end = 1.75 * severance(service + left) + reward(service + left)
    payments.append((left, alive * end))
    value = lambda at: sum(p * (1 + a["salary"]) ** when * (1 + a["discount"]) ** -when * share(when, at) for when, p in payments)
    return value(0), value(1) - value(0), end * (1 + a["salary"]) ** left


def inputs(spark, n=300):
    rng = random.Random(9)
    people = []
    for k in range(n):
        hired = dt.date(2024, 6, 30) - dt.timedelta(rng.randrange(1, 12000))
        birth = hired - dt.timedelta(rng.randrange(18 * 365, 40 * 365))
        left_on = hired + dt.timedelta(rng.randrange(100, 9000)) if k % 5 == 0 else None
        people.append((k, k % 3, "FM"[k % 2], birth, hired, left_on, rng.randrange(10**6, 10**10)))
    settings = [(0, 0.07, 0.05, 0.1, 0.06, 55, 30, 55), (1, 0.065, 0.0, 0.0, 0.0, 58, 30, 45), (2, 0.005, 0.08, 0.2, 0.1, 56, 25, 50)]
    qx = {s: [round(0.0004 * 1.085**x * (1.2 if s == "M" else 1), 6) for x in range(60 if s == "F" else 112)] for s in "FM"}
    frames = (
        spark.createDataFrame(people, "employee_id long, entity_id int, sex string, birth date, hired date, left_on date, wage long"),
        spark.createDataFrame(settings, "entity_id int, discount double, salary double, disability double, resign double, retirement_age int, flat_until int, zero_age int"),
        spark.createDataFrame([(s, x, q) for s, row in qx.items() for x, q in enumerate(row)], "sex string, age int, qx double"),
    )
    names = ("discount", "salary", "disability", "resign", "retirement_age", "flat_until", "zero_age")
    return people, {e: dict(zip(names, r)) for e, *r in settings}, qx, frames


def worth(person, at, setting, qx):
    """(dbo, service cost, benefit) of one employee in money."""
    _, _, sex, birth, hired, _, wage = person
    f = loop_of_factors((at - birth).days / 365.25, (at - hired).days / 365.25, qx[sex], setting)
    return [half_up(wage * math.floor(x * 10**9 + 0.5), 10**9) for x in f]


def near(a, b, wage):
    """Equal but for a unit of the factor's ninth decimal, where sums in another order may round the other way."""
    return abs(a - b) <= wage // 10**9 + 1


def test_valued_employees_match_a_loop(spark):
    people, settings, qx, (staff, set_, rates) = inputs(spark)
    at = dt.date(2024, 6, 30)
    rows = staff.selectExpr("employee_id", "entity_id", "sex", "birth", "hired", "wage", "date'2024-06-30' as valued_on")
    got = {r.employee_id: r for r in benefits.valued_employees(rows, set_, rates).collect()}
    assert len(got) == len(people)
    for person in people:
        r, wage = got[person[0]], person[6]
        for a, b in zip((r.dbo, r.service_cost, r.benefit_at_retirement), worth(person, at, settings[person[1]], qx)):
            assert near(a, b, wage)
    assert any(r.years_to_retirement == 0 for r in got.values())


def test_valuations_book_what_is_missing(spark):
    people, settings, qx, (staff, set_, rates) = inputs(spark)
    lines = [("JOURNAL", 0, "2310", dt.date(2023, 12, 1), 0, 5000), ("BENEFIT", 1, "2310", dt.date(2023, 5, 1), 0, 700), ("BENEFIT", 0, "3200", dt.date(2024, 2, 1), 900, 0), ("BENEFIT", 0, "6105", dt.date(2024, 3, 1), 44, 0), ("BENEFIT", 0, "2310", dt.date(2024, 8, 1), 0, 10**9)]
    books = spark.createDataFrame(lines, "entry_kind string, entity_id int, account string, day date, debit long, credit long")
    valued = benefits.valuations(staff, set_, rates, books, 2024, 6)
    at, opening = dt.date(2024, 6, 30), dt.date(2023, 12, 31)
    active = lambda p, d: p[4] <= d and (p[5] is None or p[5] > d)
    rows = {r.entity_id: r for r in valued.collect()}
    for e, setting in settings.items():
        r, mine = rows[e], [p for p in people if p[1] == e]
        slack = sum(p[6] // 10**9 + 1 for p in mine)
        total = lambda d, k, s=setting, own=mine: sum(worth(p, d, s, qx)[k] for p in own if active(p, d))
        assert r.n_employees == sum(active(p, at) for p in mine)
        assert abs(r.dbo - total(at, 0)) <= slack and abs(r.opening_cost - total(opening, 1)) <= slack
        assert abs(r.discount_down - total(at, 0, setting | {"discount": max(0, setting["discount"] - 0.01)})) <= slack
        assert abs(r.salary_up - total(at, 0, setting | {"salary": setting["salary"] + 0.01})) <= slack
        assert r.opening_interest == half_up((r.opening_dbo + r.opening_cost) * round(setting["discount"] * 10**4), 10**4)
        new = sum(worth(p, at, setting, qx)[0] for p in mine if active(p, at) and p[4] > opening)
        assert abs(r.expense_target - half_up((r.opening_cost + r.opening_interest) * 6, 12) - new) <= slack
        held = {0: (5000, 5000, 44, 900), 1: (700, 700, 0, 0), 2: (0, 0, 0, 0)}[e]
        assert r.liability == held[0] - r.dbo and r.expense == r.expense_target - held[2]
        assert r.retained == (0 if e == 1 else r.opening_dbo - held[1] - held[3])
        assert r.expense + r.retained + r.remeasurement + r.liability == 0
    booked = benefits.benefit_lines(valued, "2024-06-30").groupBy("entity_id").agg({"debit": "sum", "credit": "sum"}).collect()
    assert len(booked) == 3 and all(r["sum(debit)"] == r["sum(credit)"] for r in booked)


def test_fiscal_spans():
    assert benefits._span(2024, 6, 12) == (dt.date(2024, 6, 30), dt.date(2024, 1, 1), dt.date(2023, 12, 31), 6)
    assert benefits._span(2024, 2, 3) == (dt.date(2024, 2, 29), dt.date(2023, 4, 1), dt.date(2023, 3, 31), 11)
    assert benefits._span(2024, 4, 3) == (dt.date(2024, 4, 30), dt.date(2024, 4, 1), dt.date(2024, 3, 31), 1)
