"""Corrections, removals and backing on rows worked out by hand."""

import datetime as dt

from ledgerloom.operators import corrections


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


LINES = "line_id string, entry_id string, entry_kind string, entity_id int, day date, account string, debit long, credit long, source boolean"


def test_suspense_corrections(spark):
    rows = [
        # fits, with one other line of the amount; the zero line and the other amount don't count
        ("a1", "a", "MANUAL", 1, day(3), "1999", 70, 0, True), ("a2", "a", "MANUAL", 1, day(3), "6100", 0, 70, False), ("a3", "a", "MANUAL", 1, day(3), "1100", 0, 30, False),
        # two others of the amount: no counter; and one that the balance does not hold any more
        ("b1", "b", "MANUAL", 1, day(4), "1999", 10, 0, True), ("b2", "b", "MANUAL", 1, day(4), "6100", 10, 0, False), ("b3", "b", "MANUAL", 1, day(4), "6200", 0, 10, False),
        ("c1", "c", "MANUAL", 1, day(5), "1999", 500, 0, True), ("x1", "x", "MANUAL", 1, day(6), "1999", 0, 480, False),
        # a bank line in review isn't a difference; the old line is out of the span
        ("k1", "k", "BANK", 1, day(7), "1999", 9000, 0, False), ("o1", "o", "MANUAL", 1, day(-9), "1999", 0, 20, True),
        # offsetting lines leave a remainder; a decided line alone leaves nothing to reverse but the rest
        ("d1", "d", "MANUAL", 2, day(1), "1999", 50, 0, True), ("e1", "e", "MANUAL", 2, day(2), "1999", 0, 60, True), ("y1", "y", "MANUAL", 2, day(3), "1999", 13, 0, False),
        ("f1", "f", "MANUAL", 3, day(1), "1999", 8, 0, True), ("z1", "z", "MANUAL", 3, day(2), "1999", 0, 8, False),
    ]
    lines = spark.createDataFrame(rows, LINES)
    decided = spark.createDataFrame([("e1",)], "line_id string")
    got = sorted(map(tuple, corrections.suspense_corrections(lines, decided, "2024-01-01", "2024-01-31").collect()), key=str)
    # entity 1 holds 70 + 10 + 500 - 480 - 20 = 80, entity 2 holds 50 - 60 + 13 = 3, entity 3 nothing
    assert got == [(1, "a1", "a", 70, "6100"), (1, "b1", "b", 10, None), (2, None, "e", 3, None)]


def test_import_removals_name_what_stands_in_the_way(spark):
    kinds = [("free", 1, "STATEMENT", "POSTED"), ("draft", 1, "LEDGER", "DRAFT"), ("shut", 2, "STATEMENT", "POSTED"), ("used", 1, "LEDGER", "POSTED"), ("open", 3, "LEDGER", "POSTED"), ("late", 4, "LEDGER", "POSTED"), ("under", 5, "STATEMENT", "POSTED"), ("bridge", 5, "LEDGER", "POSTED"), ("half", 6, "STATEMENT", "POSTED"), ("empty", 6, "STATEMENT", "POSTED")]
    imports = spark.createDataFrame(kinds, "import_id string, entity_id int, kind string, status string")
    entries = [("free", "e1", 1, "BANK", 40), ("draft", "e2", 1, "MANUAL", 40), ("shut", "e3", 2, "BANK", 5), ("used", "e4", 1, "MANUAL", 40), ("used", "e5", 1, "MANUAL", 41), ("open", "e6", 3, "OPENING", 0), ("late", "e7", 4, "OPENING", 0), ("under", "e8", 5, "BANK", 10), ("bridge", "e9", 5, "OPENING", -1), ("half", "e10", 6, "BANK", 40)]
    lines = spark.createDataFrame([(i, e, n, k, day(d), a, *s) for i, e, n, k, d in entries for a, s in (("1100", (7, 0)), ("4100", (0, 7)))], "import_id string, entry_id string, entity_id int, entry_kind string, day date, account string, debit long, credit long")
    rests = [
        ("ASSET", "pump", "e4", 1, None, None), ("SCHEDULE", "rent", "e5", 1, None, None), ("SCHEDULE", "lease", "e5", 1, None, None), ("ASSET", "van", "e4", 1, None, None), ("REVERSAL", "r", "e5", 1, None, None), ("SETTLEMENT", "inv 9", "e2", 1, None, None),
        ("OLD_ASSET", "house", None, 3, day(-100), None), ("OLD_ASSET", "car", None, 4, day(100), None), ("BRIDGE", "balance of May", None, 5, day(20), "bridge"), ("PAIR", "other half", "e10", 6, day(3), None),
    ]
    rests = spark.createDataFrame(rests, "kind string, name string, entry_id string, entity_id int, day date, import_id string")
    locked = spark.createDataFrame([(2, 2024 * 12), (6, 2024 * 12)], "entity_id int, month int")
    heads, nets = corrections.import_removals(imports, lines, rests, locked)
    got = {r.import_id: (r.reason, r.names, r.n_names, r.n_entries) for r in heads.collect()}
    assert got == {
        "free": (None, None, 0, 1), "draft": ("DRAFT", "", 0, 1), "shut": ("LOCKED", "2024-01", 1, 1), "used": ("RESTING", "lease, pump, rent", 4, 2), "open": ("OPENING", "house", 1, 1),
        "late": (None, None, 0, 1), "under": ("BRIDGE", "balance of May", 1, 1), "bridge": (None, None, 0, 1), "half": ("PAIR", "other half", 1, 1), "empty": (None, None, 0, 0),
    }
    assert {(r.import_id, r.account, r.net) for r in nets.collect()} == {(i, a, s) for i in ("free", "late", "bridge") for a, s in (("1100", 7), ("4100", -7))}


def test_suggestions_need_something_to_settle(spark):
    chart = spark.createDataFrame([("1130", "RECEIVABLES"), ("2100", "PAYABLES"), ("4100", "REVENUE")], "account string, fs_line string")
    lines = spark.createDataFrame([(1, day(5), "1130", 10, 0), (1, day(9), "1130", 0, 10), (1, day(5), "2100", 0, 4), (2, day(1), "1130", 5, 0)], "entity_id int, day date, account string, debit long, credit long")
    asked = [(1, 1, day(4), 5, "1130", "AI", 85), (2, 1, day(5), 5, "1130", "AI", 85), (3, 1, day(9), 5, "1130", "AI", 85), (4, 1, day(9), 5, "1130", "RULE", 95), (5, 1, day(9), -5, "2100", "AI", 85), (6, 1, day(4), -5, "2100", "AI", 40), (7, 1, day(4), 5, "4100", "AI", 85), (8, 3, day(9), 5, "1130", "AI", 85), (9, 1, day(1), -5, "1130", "AI", 85)]
    frame = spark.createDataFrame(asked, "line_id int, entity_id int, day date, amount long, account string, method string, confidence_pct int")
    got = {r.line_id: (r.confidence_pct, r.reason) for r in corrections.backed_suggestions(frame, lines, chart).collect()}
    assert got == {1: (55, "NO_RECEIVABLE"), 2: (85, None), 3: (55, "NO_RECEIVABLE"), 4: (95, None), 5: (85, None), 6: (40, "NO_PAYABLE"), 7: (85, None), 8: (55, "NO_RECEIVABLE"), 9: (85, None)}
