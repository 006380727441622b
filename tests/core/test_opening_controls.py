"""Checks of openings and foreign bank accounts on rows worked out by hand."""

import datetime as dt

from ledgerloom.operators import controls


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_opening_controls(spark):
    rows = [
        (1, "OPENING", day(-1), "1100", 9, 0), (1, "OPENING", day(-1), "3290", 0, 9), (1, "BANK", day(4), "1100", 5, 0),  # a difference is left
        (2, "OPENING", day(-1), "3290", 0, 9), (2, "MANUAL", day(5), "3290", 9, 0),  # decided
        (3, "BANK", day(4), "1100", 5, 0),  # begins in the month without one
        (4, "BANK", day(-9), "1100", 5, 0),  # began before
        (5, "IMPORTED", day(4), "1100", 5, 0), (6, "BANK", day(99), "1100", 5, 0), (7, "BANK", day(3), "1100", 5, 0), (7, "IMPORTED", day(99), "1100", 5, 0),
    ]
    lines = spark.createDataFrame(rows, "entity_id int, entry_kind string, day date, account string, debit long, credit long")
    got = {(r.entity_id, r.check_key[8:]): (r.status, r.amount) for r in controls.opening_controls(lines, "2024-01-01", "2024-01-31").collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == "DIFFERENCE"} == {1: ("FAIL", 9), 2: ("PASS", 0), 3: ("PASS", 0), 4: ("PASS", 0), 5: ("PASS", 0), 7: ("PASS", 0)}
    assert {k[0]: v[0] for k, v in got.items() if k[1] == "RECORDED"} == {1: "PASS", 2: "PASS", 3: "REVIEW", 4: "PASS", 5: "PASS", 7: "PASS"}


def test_foreign_banks(spark):
    rows = [(1, day(1), "1101", 9, 0), (1, day(2), "1102", 5, 0), (1, day(2), "1103", 0, 2), (2, day(2), "1102", 7, 0), (2, day(3), "1101", 4, 0), (2, day(4), "1101", 0, 4), (3, day(1), "1104", 6, 0), (3, day(99), "1101", 6, 0), (3, day(1), "4100", 0, 6)]
    lines = spark.createDataFrame(rows, "entity_id int, day date, account string, debit long, credit long")
    banks = spark.createDataFrame([("1101", 1), ("1102", 2), ("1103", 3), ("1104", 3), ("1104", 1), ("1104", 2)], "account string, entity_id int")
    got = sorted(tuple(r) for r in controls.foreign_banks(lines, banks, "2024-01-31").collect())
    assert got == [(1, 3, "1102, 1103"), (3, 6, "1104")]
