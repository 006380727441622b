"""MT940 files worked out by hand: what is read, and the first fault of each broken one."""

from datetime import date

from ledgerloom.sources import mt940

HEAD = [":20:A", ":25:CENAIDJA/0000012345", ":28C:7/1", ":60F:C240101IDR100,"]
GOOD = [*HEAD, ":61:2401020103D30,5NTRFNONREF//B1", ":86:PAY", "  rent ", ":61:240102RD0,50FMSCX1", ":62F:C240103IDR70,00", "-}"]
NEXT = [":20:B", ":25:0000012345", ":28C:8/1", ":60F:C240103IDR70,", ":61:240104C5,NTRFAB", ":62F:C240104IDR75,", "-"]

FAULTS = {
    "good": (GOOD, None),
    "two days": (GOOD + NEXT, None),
    "pages": ([*HEAD, ":62M:C240103IDR100,", ":20:B", ":25:0000012345", ":28C:7/2", ":60M:C240103IDR100,", ":62F:C240103IDR100,"], None),
    "a new year begins at 1": ([":20:A", ":25:X1", ":28:312", ":60F:C231230IDR1,", ":62F:C231231IDR1,", ":20:B", ":25:X1", ":28:1", ":60F:C240101IDR1,", ":62F:C240101IDR1,"], ("DAYS_MISSING", 9)),
    "a new year": ([":20:A", ":25:X1", ":28:312", ":60F:C231230IDR1,", ":62F:C240101IDR1,", ":20:B", ":25:X1", ":28:1", ":60F:C240101IDR1,", ":62F:C240101IDR1,"], None),
    "two accounts": ([*GOOD, ":20:B", ":25:777", ":60F:D240301USD1,", ":62F:D240302USD1,"], None),
    "no tags": (["hello", ""], ("NO_OPENING", None)),
    "no opening at all": ([":25:1", ":28:1"], ("NO_OPENING", None)),
    "cut off in the middle": ([":20:A", ":25:1", *GOOD], ("CUT_OFF", 1)),
    "cut off at the end": ([*GOOD, ":20:B"], ("CUT_OFF", 11)),
    "account again": ([":20:A", ":25:1", ":25:2", *GOOD], ("ACCOUNT_AGAIN", 3)),
    "page again": ([":20:A", ":28:1", ":28C:1", ":25:2"], ("PAGE_OUT_OF_PLACE", 3)),
    "page behind the opening": ([":20:A", ":25:1", ":60F:C240101IDR1,", ":28:1"], ("PAGE_OUT_OF_PLACE", 4)),
    "page 0": ([":20:A", ":28C:1/0"], ("PAGE_INVALID", 2)),
    "page of words": ([":20:A", ":28C:first"], ("PAGE_INVALID", 2)),
    "opening again": ([*HEAD, ":60M:C240101IDR100,"], ("OPENING_AGAIN", 5)),
    "no account": ([":20:A", ":60F:C240101IDR100,"], ("NO_ACCOUNT", 2)),
    "empty account": ([":20:A", ":25:", ":60F:C240101IDR100,"], ("NO_ACCOUNT", 3)),
    "balance with a point": ([":20:A", ":25:1", ":60F:C240101IDR100.00"], ("BALANCE_UNREADABLE", 3)),
    "30 February": ([":20:A", ":25:1", ":60F:C240230IDR100,"], ("NO_SUCH_DAY", 3)),
    "movement first": ([":20:A", ":25:1", ":61:240102C1,NTRFX"], ("MOVEMENT_BEFORE_OPENING", 3)),
    "movement last": ([*GOOD[:-1], ":61:240102C1,NTRFX"], ("MOVEMENT_AFTER_CLOSING", 10)),
    "movement without a comma": ([*HEAD, ":61:240102C1NTRFX"], ("MOVEMENT_UNREADABLE", 5)),
    "movement on 31 April": ([*HEAD, ":61:240431C1,NTRFX"], ("NO_SUCH_DAY", 5)),
    "booked on 31 April": ([*HEAD, ":61:2404300431C1,NTRFX"], ("NO_SUCH_DAY", 5)),
    "closing first": ([":20:A", ":25:1", ":62F:C240101IDR1,"], ("CLOSING_WITHOUT_OPENING", 3)),
    "closing again": ([*GOOD[:-1], ":62F:C240103IDR70,00"], ("CLOSING_AGAIN", 10)),
    "other currency": ([*HEAD, ":62F:C240103USD100,"], ("OTHER_CURRENCY", 5)),
    "no closing": (HEAD, ("NO_CLOSING", 4)),
    "closing before": ([*HEAD, ":62F:C231231IDR100,"], ("CLOSING_BEFORE_OPENING", 4)),
    "day outside": ([*HEAD, ":61:240105C1,NTRFX", ":62F:C240103IDR101,"], ("DAY_OUTSIDE", 4)),
    "sum": ([*HEAD, ":61:240102C0,001NTRFX", ":62F:C240103IDR100,"], ("SUM", 4)),
    "tag before sum": ([*HEAD, ":62F:C240103IDR101,", ":62F:C240103IDR101,"], ("CLOSING_AGAIN", 6)),
    "sum of the second before the chain": (GOOD + [":20:B", ":25:0000012345", ":60F:C240109IDR70,", ":62F:C240109IDR71,"], ("SUM", 13)),
    "starts amid pages": ([":20:A", ":25:1", ":60M:C240101IDR1,", ":62F:C240101IDR1,"], ("PAGES_INCOMPLETE", 3)),
    "ends amid pages": ([*HEAD, ":62M:C240103IDR100,"], ("PAGES_INCOMPLETE", 4)),
    "starts at page 2": ([":20:A", ":25:1", ":28C:7/2", ":60F:C240101IDR1,", ":62F:C240101IDR1,"], ("FIRST_PAGE_MISSING", 4)),
    "days back": (GOOD + [":20:B", ":25:0000012345", ":60F:C240102IDR70,", ":62F:C240109IDR70,"], ("DAYS_OUT_OF_ORDER", 13)),
    "days missing": (GOOD + [":20:B", ":25:0000012345", ":60F:C240104IDR70,", ":62F:C240109IDR70,"], ("DAYS_MISSING", 13)),
    "final then intermediate": (GOOD + [":20:B", ":25:0000012345", ":60M:C240103IDR70,", ":62F:C240109IDR70,"], ("INTERMEDIATE_BALANCE", 13)),
    "page missing": (GOOD + [":20:B", ":25:0000012345", ":28C:9/1", ":60F:C240103IDR70,", ":62F:C240109IDR70,"], ("PAGE_MISSING", 14)),
    "broken": (GOOD + [":20:B", ":25:0000012345", ":60F:D240103IDR70,", ":62F:D240109IDR70,"], ("BALANCE_BROKEN", 13)),
    "first group first": ([":20:A", ":25:1", ":60F:C240101IDR1,", ":62F:C240101IDR1,", ":20:B", ":25:2", ":60M:C240101IDR1,", ":62F:C240101IDR1,", ":20:C", ":25:1", ":60F:C240101IDR2,", ":62F:C240101IDR2,"], ("BALANCE_BROKEN", 11)),
}


def lines_of(spark, files):
    return spark.createDataFrame([(f, k, t) for f, ls in files.items() for k, t in enumerate(ls, 1)], "file string, line_no long, text string")


def test_first_faults(spark):
    got = {r.file: (r.fault, r.line_no) for r in mt940.faults(lines_of(spark, {k: ls for k, (ls, _) in FAULTS.items()})).collect()}
    assert got == {k: v for k, (_, v) in FAULTS.items() if v}


def test_rows_and_statements(spark):
    envelope = "{1:F01CENAIDJA0}{2:I940X}{3:{108:A}{119:B}}{4:"
    files = {
        "one": ["﻿" + envelope, *GOOD[:-1], "-}{5:{CHK:1}}", envelope + NEXT[0], *NEXT[1:]],
        "words": [":20:A", ":25:IDR0000 012 345", ":60F:C231231IDR0,", ":61:2312310101C12,34NTRFNONREF//R 1", "more", ":86:", ":61:240101RC2,34NCHGNONREF", ":86:one", ":86:two", ":62F:C240105IDR10,", ":86:of the closing"],
        "quiet": [":20:A", ":25:ABC/XY 1", ":60F:D240101IDR5,", ":62F:D240102IDR5,"],
        "broken": [*GOOD, ":20:B"],
        "year back": [":20:A", ":25:1", ":60F:C231230IDR0,", ":61:2401021231C1,NTRFX", ":62F:C240102IDR1,"],
    }
    lines = lines_of(spark, files)
    rows = sorted((r.file, r.line_no, r.account_number, r.day, r.description, r.amount, r.balance) for r in mt940.rows(lines).collect())
    assert rows == [
        ("one", 6, "0000012345", date(2024, 1, 3), "PAY rent", -3050, None),
        ("one", 9, "0000012345", date(2024, 1, 2), "MSC X1", 50, 7000),
        ("one", 16, "0000012345", date(2024, 1, 4), "TRF AB", 500, 7500),
        ("words", 4, "0000012345", date(2024, 1, 1), "TRF R1 more", 1234, None),
        ("words", 7, "0000012345", date(2024, 1, 1), "two", -234, 1000),
        ("year back", 4, "1", date(2023, 12, 31), "TRF X", 100, 100),
    ]
    got = {r.file: tuple(r)[1:] for r in mt940.statements(lines).collect()}
    assert got == {
        "one": ("0000012345", "IDR", date(2024, 1, 2), date(2024, 1, 4), 10000, 7500, 2, 3),
        "words": ("0000012345", "IDR", date(2024, 1, 1), date(2024, 1, 5), 0, 1000, 1, 2),
        "quiet": ("XY1", "IDR", date(2024, 1, 2), date(2024, 1, 2), -500, -500, 1, 0),
        "year back": ("1", "IDR", date(2023, 12, 31), date(2024, 1, 2), 0, 100, 1, 1),
    }


def test_no_files(spark):
    none = lines_of(spark, {})
    assert mt940.rows(none).count() == mt940.statements(none).count() == mt940.faults(none).count() == 0
