"""Proceeds, repairs and overlaps against plain loops over invented rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import proceeds, repair


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def loop_of_proceeds(lines, tags, bank):
    cash = {("b", k): abs(v) for k, v in bank}
    for l in lines:
        if l[7] is None and l[4] == "1100" and l[5] > 0:
            cash["e", l[1]] = cash.get(("e", l[1]), 0) + l[5]
    queue, ahead, got, trail = {}, {}, {}, []
    for line_id, entry, entity, _, account, debit, credit, bank_id in sorted((l for l in lines if l[4] != "1100"), key=lambda l: (l[3], l[0])):
        place, net = (entity, account), debit - credit
        q = queue.setdefault(place, [])
        if net > 0 and bank_id is not None:
            for c in reversed([c for c in trail if c["bank"] == bank_id and c["place"] == place]):
                if not net:
                    break
                undo = min(c["amount"], net)
                back = max(undo - (c["amount"] - c["cash"]), 0)
                if c["advance"]:
                    ahead[place] = ahead.get(place, 0) - undo
                else:
                    q.insert(0, [c["tag"], undo])
                    if c["tag"] is not None:
                        got[c["tag"]] = got.get(c["tag"], 0) - back
                cash["b", bank_id] = cash.get(("b", bank_id), 0) + back
                c["amount"] -= undo
                c["cash"] -= back
                net -= undo
                if not c["amount"]:
                    trail.remove(c)
        if net > 0:
            used = min(ahead.get(place, 0), net)
            ahead[place] = ahead.get(place, 0) - used
            if net - used:
                q.append([line_id if line_id in tags else None, net - used])
        elif net < 0:
            purse = ("b", bank_id) if bank_id is not None else ("e", entry)
            rest = -net
            paid = min(cash.get(purse, 0), rest)
            cash[purse] = cash.get(purse, 0) - paid
            while rest:
                tag, amount, part = (q[0][0], min(q[0][1], rest), min(q[0][1], rest, paid)) if q else (None, rest, paid)
                if bank_id is not None:
                    trail.append({"bank": bank_id, "place": place, "tag": tag, "amount": amount, "cash": part, "advance": not q})
                if tag is not None and part:
                    got[tag] = got.get(tag, 0) + part
                if q:
                    q[0][1] -= amount
                    if not q[0][1]:
                        q.pop(0)
                else:
                    ahead[place] = ahead.get(place, 0) + amount
                rest, paid = rest - amount, paid - part
    return {k: v for k, v in got.items() if v}


LINES = "line_id long, entry_id long, entity_id int, day date, account string, debit long, credit long, bank_id long"


@pytest.mark.parametrize("reclass", [False, True])
def test_collected_proceeds_match_a_loop(spark, reclass):
    rng = random.Random(7 + reclass)
    lines, bank, tags, n = [], [], set(), 0

    def post(entity, on, bank_id, *legs):
        nonlocal n
        n += 1
        for k, (account, amount) in enumerate(legs):
            lines.append((n * 10 + k, n, entity, day(on), account, max(amount, 0), max(-amount, 0), bank_id))

    for on in range(160):
        for entity in (1, 2, 3):
            account, other, amount = rng.choice(["1130", "1140"]), rng.choice(["2100", "1140"]), rng.randrange(1, 60)
            what = rng.randrange(5)
            if what == 0:
                post(entity, on, None, (account, amount * 4), ("4100", -amount * 4))
                if rng.random() < 0.6:
                    tags.add(n * 10)
            elif what in (1, 2):  # a bank line, with a part that is not cash
                bank.append((1000 + n, amount))
                post(entity, on, 1000 + n, ("1100", amount), (account, -amount - rng.choice([0, 0, 7])), ("6100", 7))
                if reclass and rng.random() < 0.7:
                    post(entity, min(on + rng.randrange(30), 159), bank[-1][0], (account, rng.randrange(1, amount + 20)), (other, -rng.randrange(1, 40)))
            elif what == 3:  # a typed entry with cash on it, both sides on one account
                post(entity, on, None, ("1100", amount // 2), (account, -amount), (account, rng.choice([0, amount // 3])), ("6100", amount - amount // 2))
            else:
                post(entity, on, None, (account, -amount), ("6100", amount))
    frame = spark.createDataFrame(lines, LINES)
    chart = spark.createDataFrame([("1100", "CASH"), ("1130", "RECEIVABLES")], "account string, fs_line string")
    asked = spark.createDataFrame([(l[0], l[4]) for l in lines if l[0] in tags], "line_id long, account string")
    got = proceeds.collected_proceeds(frame, asked, spark.createDataFrame(bank, "bank_id long, amount long"), chart, "2024-12-31").collect()
    codes = {l[4] for l in lines if l[0] in tags}
    want = loop_of_proceeds([l for l in lines if l[4] in codes | {"1100"}], tags, bank)
    assert {r.line_id: r.collected for r in got} == want and len(want) > 20


def loop_of_repair(rows, opening, closing):
    """rows: (nth, amount, balance, only). Returns what stays and whether it was repaired."""
    running, trial, mended, stays = opening, [], 0, []
    for k, (nth, amount, balance, only) in enumerate(rows):
        proof = any(b is not None and not o for _, _, b, o in rows[k + 1 :])
        if only:
            if balance is None or balance == running:
                continue
            trial.append((nth, balance - running if proof else 0, "AMOUNT" if proof else None, balance))
            mended += proof
            stays.append((nth, 0, "AMOUNT_UNPROVED"))
            running = balance
        elif balance is not None and balance != running + amount and amount and running - amount == balance:
            trial.append((nth, -amount if proof else amount, "FLIPPED" if proof else None, balance))
            mended += proof
            stays.append((nth, amount, "FLIP_UNPROVED"))
            running = balance
        else:
            trial.append((nth, amount, None, balance))
            stays.append((nth, amount, None))
            running = running + amount if balance is None else balance
    at, fine = opening, mended > 0
    for _, amount, _, balance in trial:
        at += amount
        fine &= balance is None or balance == at
        at = at if balance is None else balance
    return [t[:3] for t in trial] if fine and at == closing else stays


def test_repair_matches_a_loop(spark):
    rng = random.Random(11)
    rows, want, kinds = [], set(), set()
    for file in range(120):
        opening = rng.randrange(1000)
        at, own = opening, []
        for nth in range(rng.randrange(1, 14)):
            amount = rng.choice([-1, 1]) * rng.randrange(1, 90)
            at += amount
            what = rng.random()
            balance = at if rng.random() < 0.8 else None
            if what < 0.07:
                own.append((nth, -amount, balance, False))
            elif what < 0.13:
                own.append((nth, 0, balance, True))
            elif what < 0.16:
                at -= amount
                own.append((nth, 0, at, True))  # nothing moved
            elif what < 0.17:
                own.append((nth, amount, at + 5, False))
            else:
                own.append((nth, amount, balance, False))
        closing = at + (file % 9 == 0)
        rows += [(file, *r, opening, closing) for r in own]
        made = loop_of_repair(own, opening, closing)
        want |= {(file, *m) for m in made}
        kinds |= {m[2] for m in made}
    frame = spark.createDataFrame(rows, "file_id int, nth int, amount long, balance long, balance_only boolean, opening long, closing long")
    got = {(r.file_id, r.nth, r.amount, r.note) for r in repair.repaired_rows(frame, "file_id", "nth").collect()}
    assert got == want and kinds == {None, "FLIPPED", "AMOUNT", "FLIP_UNPROVED", "AMOUNT_UNPROVED"}


def test_overlapping_files(spark):
    stored = [
        # a proved day, a day with a balance twice, and a last day that is proved
        (1, 9, day(1), 10, 110, "a", "S"), (2, 9, day(1), 10, 120, "b", "S"), (3, 9, day(2), 5, 125, "c", "S"), (4, 9, day(2), -5, 120, "d", "S"), (5, 9, day(2), 5, 125, "e", "S"),
        (6, 9, day(4), 7, 132, "f", "S"), (7, 8, day(4), 7, 7, "f", "S"),
    ]
    files = [
        # the same bytes
        ("same", 9, 1, day(1), 10, 110, "a", None, "S", None), ("same", 9, 2, day(4), 7, 132, "f", None, "S", None),
        # another source of the first day: one row read before its repair, one proved, one whose balance isn't there
        ("other", 9, 1, day(1), 10, 110, "x", "a", "T", None), ("other", 9, 2, day(1), 10, 120, "y", None, "T", None), ("other", 9, 3, day(1), 10, 130, "z", None, "T", None),
        # a day that can't be proved, and a movement that no stored row has
        ("cycle", 9, 1, day(2), 5, 125, "c", None, "T", None), ("cycle", 9, 2, day(2), 8, 133, "q", None, "T", None),
        # goes on where the stored rows end, with a twin of another balance
        ("next", 9, 1, day(4), 7, 139, "g", None, "T", 132), ("next", 9, 2, day(5), 1, 140, "h", None, "T", 132),
        # the same without the printed opening
        ("loose", 9, 1, day(4), 7, 139, "g", None, "T", None),
    ]
    frame = spark.createDataFrame([(*r, r[3], r[3]) for r in files], "file_id string, bank_account int, row_no int, day date, amount long, balance long, hash string, written_hash string, source_hash string, opening long, first_day date, last_day date")
    old = spark.createDataFrame(stored, "stored_id long, bank_account int, day date, amount long, balance long, hash string, source_hash string")
    got = {(r.file_id, r.row_no): (r.decision, r.stored_id) for r in repair.overlapping_rows(frame, old).collect()}
    assert got == {
        ("same", 1): ("SAME", 1), ("same", 2): ("SAME", 6),
        ("other", 1): ("WRITTEN", 1), ("other", 2): ("PROVED", 2), ("other", 3): ("NEW", None),
        ("cycle", 1): ("REFUSED", None), ("cycle", 2): ("NEW", None),
        ("next", 1): ("NEW", None), ("next", 2): ("NEW", None), ("loose", 1): ("REFUSED", None),
    }


def test_proceeds_of_empty_tables(spark):
    lines = spark.createDataFrame([], LINES)
    chart = spark.createDataFrame([("1100", "CASH")], "account string, fs_line string")
    got = proceeds.collected_proceeds(lines, lines.select("line_id", "account"), lines.select("bank_id", F.lit(1).cast("long").alias("amount")), chart, "2024-12-31")
    assert got.collect() == []
