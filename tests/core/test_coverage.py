"""Lines covered by schedules, each case worked out by hand."""

from ledgerloom.operators import coverage

CASES = {
    # entry: lines (account, name, fs_line, net), schedules (id, source, kind, debit, credit, amount, memo), covered
    "stored source": ([("1210", "Vehicles", "FIXED_ASSETS", 90)], [(1, "1210", "DEPRECIATION", "6180", "1219", 5, "x")], {"1210": 1}),
    "unknown source": ([("1210", "Vehicles", "FIXED_ASSETS", 90)], [(1, "9999", "DEPRECIATION", "6180", "1219", 90, "vehicles")], {}),
    "released side": ([("1170", "Prepaid rent", "PREPAID", 90), ("2160", "Unearned", "LIABILITY", -40)], [(1, None, "PREPAYMENT", "6120", "1170", 7, ""), (2, None, "REVENUE", "2160", "4110", 7, "")], {"1170": 1, "2160": 2}),
    "wrong side": ([("1170", "Prepaid rent", "PREPAID", 90)], [(1, None, "PREPAYMENT", "1170", "6120", 90, "")], {}),
    "no movement that fits": ([("1170", "Prepaid rent", "PREPAID", -90), ("2160", "Unearned", "LIABILITY", 40)], [(1, None, "PREPAYMENT", "2160", "1170", 90, "1170")], {}),
    "memo before amount": ([("1170", "Prepaid rent", "PREPAID", 90), ("2160", "Unearned", "LIABILITY", -40)], [(1, None, "OTHER", "2160", "1170", 90, "release of Unearned")], {"2160": 1}),
    "amount before order": ([("1170", "Prepaid rent", "PREPAID", 90), ("2160", "Unearned", "LIABILITY", -40)], [(1, None, "OTHER", "2160", "1170", 40, "")], {"2160": 1}),
    "one each": ([("1170", "Prepaid rent", "PREPAID", 90)], [(1, None, "OTHER", "6120", "1170", 90, ""), (2, None, "OTHER", "6120", "1170", 90, "")], {"1170": 1}),
    "code in the memo": ([("1210", "Vehicles", "FIXED_ASSETS", 90), ("1220", "Tools", "FIXED_ASSETS", 30)], [(1, None, "DEPRECIATION", "6180", "1219", 90, "Depreciation 1220 Vehicles")], {"1220": 1}),
    "longest name": ([("1210", "Car", "FIXED_ASSETS", 90), ("1220", "Car park", "FIXED_ASSETS", 30)], [(1, None, "DEPRECIATION", "6180", "1219", 7, "the car park of 2024")], {"1220": 1}),
    "name with the amount": ([("1210", "Car", "FIXED_ASSETS", 90), ("1220", "Car park", "FIXED_ASSETS", 30)], [(1, None, "DEPRECIATION", "6180", "1219", 90, "the car park of 2024")], {"1210": 1}),
    "amount": ([("1210", "Car", "FIXED_ASSETS", 90), ("1220", "Tools", "FIXED_ASSETS", 30)], [(1, None, "DEPRECIATION", "6180", "1219", 30, "")], {"1220": 1}),
    "only asset": ([("1210", "Car", "FIXED_ASSETS", 90)], [(1, None, "DEPRECIATION", "6180", "1219", 7, "custom")], {"1210": 1}),
    "points elsewhere": ([("1210", "Car", "FIXED_ASSETS", 90), ("1170", "Prepaid rent", "PREPAID", 7)], [(1, None, "DEPRECIATION", "6180", "1219", 7, "custom")], {}),
    "elsewhere is taken": ([("1210", "Car", "FIXED_ASSETS", 90), ("1170", "Prepaid rent", "PREPAID", 7)], [(1, None, "DEPRECIATION", "6180", "1219", 7, "custom"), (2, None, "OTHER", "6120", "1170", 3, "")], {"1210": 1, "1170": 2}),
    "depreciation of a prepayment": ([("1210", "Car", "FIXED_ASSETS", 90), ("1170", "Prepaid rent", "PREPAID", 7)], [(1, None, "DEPRECIATION", "6180", "1170", 7, "custom")], {"1170": 1}),
    "none": ([("1210", "Car", "FIXED_ASSETS", 90)], [], {}),
}


def test_covered_lines(spark):
    lines = [(1, e, k, a, n, f, max(net, 0), max(-net, 0)) for e, (ls, _, _) in CASES.items() for k, (a, n, f, net) in enumerate(ls)]
    made = [(i, 1, e, *s) for e, (_, ss, _) in CASES.items() for i, *s in ss] + [(9, 1, "no such entry", None, "OTHER", "1", "2", 3, None), (9, 2, "only asset", None, "DEPRECIATION", "1", "2", 3, None)]
    lines = spark.createDataFrame(lines, "entity_id int, entry_id string, line_id int, account string, account_name string, fs_line string, debit long, credit long")
    made = spark.createDataFrame(made, "schedule_id int, entity_id int, entry_id string, source_account string, kind string, debit_account string, credit_account string, amount long, memo string")
    rows = coverage.covered_lines(lines, made).collect()
    got = {e: {r.account: r.schedule_id for r in rows if r.entry_id == e and r.schedule_id is not None} for e in CASES}
    assert got == {e: c for e, (_, _, c) in CASES.items()} and len(rows) == lines.count()
    assert coverage.covered_lines(lines.limit(0), made).collect() == []
