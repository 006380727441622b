"""Staging of ledger files against plain sums, and trial balances by hand."""

import collections
import datetime as dt
import random

from ledgerloom.operators import staging

ROWS = "file_id string, row_no int, entity_key string, day date, code string, name string, debit long, credit long, currency string, rate_num long, rate_scale int, voucher string, error string"


def away(n, d):
    return (1 if n >= 0 else -1) * ((2 * abs(n) + d) // (2 * d))


def files(n=900):
    rng = random.Random(12)
    out = []
    for f in ("vouchers", "days"):
        for row in range(n):
            cur = rng.choice([None, None, None, "USD", "IDR", "XXX"] if row % 40 == 0 else [None, None, "IDR", "USD"])
            out.append((f, row, rng.choice(["a", "b", "a", "z"] if row % 50 == 0 else ["a", "b"]), dt.date(2024, 1 + row % 9, 1 + row % 3), f"{row % 13}", f"name {row % 13}", rng.choice([0, 120, 155, -70, 3333]), rng.choice([0, 120, 155, 250]), cur, 1_500_050 if cur == "USD" and row % 3 else None, 2 if cur == "USD" and row % 3 else None, f"v{row % 97}" if f == "vouchers" and row % 5 else None, "no date" if row % 101 == 7 else None))
    for k in range(40):  # entries that balance in each currency but for rounding
        for sign in (1, -1):
            for part in (rng.randrange(1, 9999), 1):
                amount = 40_001 if part == 1 else 7 * k + 3
                out.append(("fx", len(out), "a", dt.date(2024, 1, 1), "1", "one", amount if sign > 0 else 0, amount if sign < 0 else 0, "USD" if part == 1 else None, 1_523_777 if part == 1 else None, 2 if part == 1 else None, f"x{k}", None))
        out.append(("fx", len(out), "a", dt.date(2024, 1, 1), "1", "one", 33_335 + 48 * k, 0, "USD", 1_523_777, 2, f"x{k}", None))
        out += [("fx", len(out) + i, "a", dt.date(2024, 1, 1), "2", "two", 0, c, "USD", 1_523_777, 2, f"x{k}", None) for i, c in enumerate((11_111 + 37 * k, 22_224 + 11 * k))]
    return out


def loop_of_entries(rows, own, rates):
    voucher = {f for f, *_, v, e in rows if v and not e}
    groups = collections.defaultdict(list)
    for r in rows:
        f, row, key, day, code, name, d, k, cur, num, scale, v, error = r
        if error or key not in own or cur not in (None, "USD", "IDR"):
            continue
        if d < 0:
            d, k = 0, k - d
        if k < 0:
            d, k = d - k, 0
        groups[f, key, (v or "") if f in voucher else "", day].append((d - k, cur if cur and cur != own[key] else None, num, scale))
    out = {}
    for g, lines in groups.items():
        exp = {"IDR": 0, "USD": 2}
        mine, cents, amounts, converted, even, missing = own[g[1]], [], [], 0, collections.Counter(), False
        for signed, foreign, num, scale in lines:
            even[foreign or mine] += signed
            if foreign and rates is not None:
                num, scale = (num, scale) if num is not None else rates.get((foreign, mine, g[3]), (None, None))
                if num is None:
                    missing = True
                    continue
                minor = abs(signed) if exp[foreign] == 2 else away(abs(signed), 100)
                value = away(minor * num * 10 ** exp[mine], 10 ** (scale + exp[foreign])) * (1 if signed >= 0 else -1)
                cents.append(value * 10 ** (2 - exp[mine]))
                amounts.append(value)
                converted += 1
            else:
                cents.append(signed)
                amounts.append(signed if exp[mine] == 2 else away(signed, 100))
        if missing:
            continue
        whole = sum(cents) if exp[mine] == 2 else away(sum(cents), 100)
        rounding, fx = whole - sum(amounts), converted > 0 and whole != 0 and abs(whole) <= converted and not any(even.values())
        out[g] = (len(lines), sum(a for a in amounts if a > 0), rounding - whole if fx else rounding, fx, 0 if fx else whole)
    return out


def test_planned_entries_match_a_loop(spark):
    rows, own = files(), {"a": "IDR", "b": "USD"}
    frame, entities = spark.createDataFrame(rows, ROWS), spark.createDataFrame(list(own.items()), "entity_key string, currency string")
    days = [dt.date(2024, m, d) for m in range(1, 6) for d in (1, 2, 3)]
    rates = {("USD", "IDR", d): (1_600_000 + d.month, 2) for d in days} | {("IDR", "USD", d): (62, 6) for d in days}
    table = spark.createDataFrame([(*k, *v) for k, v in rates.items()], "currency string, to string, day date, rate_num long, rate_scale int")
    for given, known in ((None, None), (table, rates)):
        heads, lines = staging.planned_entries(frame, entities, given)
        got = {(r.file_id, r.entity_key, r.voucher, r.day): (r.n_rows, r.debit, r.rounding, r.fx_rounding, r.imbalance) for r in heads.collect()}
        want = loop_of_entries(rows, own, known)
        assert got == want
        sums = collections.Counter()
        for r in lines.collect():
            sums[r.file_id, r.entity_key, r.voucher, r.day] += r.amount
        assert all(sums[g] == w[4] for g, w in want.items())
    assert any(w[3] for w in want.values()) and any(w[2] and not w[3] for w in want.values())


def test_findings(spark):
    day = lambda m, d=1: dt.date(2024, m, d)
    rows = [
        ("f", 1, "a", day(1), "1", "Cash", 100, 0, None, None, None, "v1", None), ("f", 2, "a", day(1), "4", "Sales", 0, 90, None, None, None, "v1", None),
        ("f", 3, "a", day(3), "1", "Bank", 500, 0, "USD", None, None, "v2", None), ("f", 4, "a", day(3), "4", "4", 0, 500, None, None, None, "v2", None),
        ("f", 5, "q", day(3), "1", "Cash", 7, 0, None, None, None, "v3", None), ("f", 6, "a", day(3), "1", "cash ", -5, 0, "ZZZ", None, None, "v3", None),
        ("f", 7, "a", None, "1", "Cash", 1, 0, None, None, None, None, "no date"), ("f", 8, "a", day(4), "1", "Cash", -5, -5, None, None, None, "v4", None),
    ]
    frame, entities = spark.createDataFrame(rows, ROWS), spark.createDataFrame([("a", "SGD")], "entity_key string, currency string")
    totals = spark.createDataFrame([("f", 9, 607, 585), ("f", 20, 602, 585)], "file_id string, row_no int, debit long, credit long")
    read = lambda df: sorted((r.severity, r.code, r.entity_key, r.about, r.n_rows, r.first_row, r.amount) for r in df.collect())
    plain = read(staging.staging_findings(frame, entities, totals=totals.filter("row_no = 9")))
    assert plain == sorted([
        ("BLOCK", "ROW_ERROR", "a", "no date", 1, 7, None), ("BLOCK", "UNKNOWN_ENTITY", "q", "", 1, 5, None), ("BLOCK", "UNKNOWN_CURRENCY", "", "ZZZ", 1, 6, None), ("BLOCK", "UNBALANCED", "a", "v1 2024-01-01", 2, 1, 10),
        ("REVIEW", "NEGATIVE_AMOUNT", "", "", 1, 8, None), ("REVIEW", "FX_SAME_NUMBER", "a", "v2 2024-03-01", 2, 3, None), ("REVIEW", "FX_NO_RATE", "a", "USD", 1, 3, 500), ("REVIEW", "CODE_RENAMED", "a", "1", 3, 1, None),
        ("REVIEW", "MISSING_MONTH", "a", "1", 0, None, None), ("REVIEW", "TOTAL_MISMATCH", "", "", 7, 9, 10),
    ], key=lambda r: tuple(map(str, r)))
    both = read(staging.staging_findings(frame, entities, rates=spark.createDataFrame([], "currency string, to string, day date, rate_num long, rate_scale int"), totals=totals))
    assert ("BLOCK", "MISSING_RATE", "a", "USD 2024-03-01", 1, 3, None) in both and not any(r[1].startswith("TOTAL") for r in both)
    fine = totals.filter("row_no = 20").selectExpr("file_id", "row_no", "597L as debit", "585L as credit")
    assert [r for r in read(staging.staging_findings(frame, entities, totals=fine)) if r[1].startswith("TOTAL")] == [("INFO", "TOTAL_OK", "", "", 7, 20, 0)]


def test_trial_balance_parts(spark):
    schema = "file_id string, code string, opening long, unadjusted long, adjustment long, adjusted long, movement long, closing long"
    rows = [("all", "1", 10, None, 5, 15, 2, 17), ("all", "2", 10, None, 5, 16, 2, 17), ("all", "3", 1, None, 1, 2, 2, 5), ("implied", "1", 10, None, None, 14, None, 20), ("sheet", "1", None, 8, None, 9, None, None), ("late", "1", None, None, 3, 9, None, None), ("end", "1", None, None, None, None, 4, 9), ("two", "1", 1, 1, None, None, None, None), ("all", "4", None, None, None, None, None, None)]
    got = {(r.file_id, r.code): tuple(r)[2:] for r in staging.trial_balance_parts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("all", "1"): (10, 5, 15, 2, 17, None), ("all", "2"): (10, 5, 16, 2, 17, "ADJUSTED"), ("all", "3"): (1, 1, 2, 2, 5, "CLOSING"), ("all", "4"): (0, 0, 0, 0, 0, None),
        ("implied", "1"): (10, 4, 14, 6, 20, None), ("sheet", "1"): (8, 1, 9, 0, 9, None), ("late", "1"): (6, 3, 9, 0, 9, None), ("end", "1"): (5, 0, 5, 4, 9, None), ("two", "1"): (1, 0, 1, 0, 1, "LAYOUT"),
    }
