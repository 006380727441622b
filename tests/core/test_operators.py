"""Operators on small invented rows with results worked out by hand or by a plain loop."""

import datetime as dt
import itertools
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from ledgerloom.operators import controls, currency, ingest, matching, posting, receivables, registers, reviews, tax
from ledgerloom.sources import statements
from ledgerloom.streaming import landing


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_transfers_pair_only_without_rivals(spark):
    rows = [(1, 1, 5, day(0), -100, "TRSF A"), (2, 2, 5, day(1), 100, "TRSF B"), (3, 1, 5, day(8), -70, "TRSF"), (4, 2, 6, day(8), 70, "TRANSFER"), (5, 3, 6, day(9), 70, "TRANSFER"), (6, 4, 5, day(20), -100, "FEE"), (7, 3, 5, day(20), 100, "TRSF")]
    pairs = matching.transfer_pairs(spark.createDataFrame(rows, "line_id long, bank_account int, entity_id int, day date, amount long, description string")).collect()
    assert sorted((p.out_id, p.in_id, p.account, p.confidence_pct) for p in pairs) == [(1, 2, "1199", 99), (3, 4, "1190", 80), (3, 5, "1190", 80)]


def test_vat_carry_matches_loop(spark):
    rng = random.Random(3)
    rows = [(e, 2024, m, rng.randrange(100), rng.randrange(140)) for e in range(30) for m in range(1, 13)]
    got = {(r.entity_id, r.month): (r.net, r.carry) for r in tax.vat_carry(spark.createDataFrame(rows, "entity_id int, year int, month int, output long, input long")).collect()}
    for e in range(30):
        carry = 0
        for _, _, m, o, i in sorted(r for r in rows if r[0] == e):
            net = o - i - carry
            carry = max(-net, 0)
            assert got[e, m] == (net, carry)


def test_fifo_and_losses(spark):
    inv = spark.createDataFrame([(1, 10, day(1), 50), (1, 11, day(0), 30), (1, 12, day(2), 40)], "contact_id long, invoice_id long, due_date date, total long")
    got = receivables.fifo_allocation(spark.createDataFrame([(1, 60)], "contact_id long, receipt long"), inv).collect()
    assert {r.invoice_id: r.allocated for r in got} == {11: 30, 10: 30}
    losses = spark.createDataFrame([(1, 2017, 40), (1, 2020, 50), (1, 2022, 60)], "entity_id int, origin_year int, amount long")
    got = tax.loss_use(losses, spark.createDataFrame([(1, 80)], "entity_id int, profit long"), 2024).collect()
    assert {r.origin_year: (r.used, r.expired) for r in got} == {2017: (0, True), 2020: (50, False), 2022: (30, False)}


def test_lease_schedule_is_exact():
    rows = registers.lease_schedule(1_000_000, 24, 3, True, 1200)
    value = sum(Fraction(1_000_000) / Fraction(121_200, 120_000) ** t for t in range(0, 24, 3))
    assert rows[0][1] == round(value) and rows[-1][4] == 0 and len(rows) == 24
    assert sum(r[2] for r in rows) == 8_000_000 and sum(r[3] for r in rows) == 8_000_000 - rows[0][1] and sum(r[5] for r in rows) == rows[0][1]


def test_fiscal_years_use_up_the_cost(spark):
    assets = spark.createDataFrame([(1, "GROUP_1", "STRAIGHT", dt.date(2020, 7, 15), 1_000_000), (2, "GROUP_1", "DECLINING", dt.date(2020, 7, 15), 1_000_000)], "asset_id long, tax_group string, method string, acquired_on date, cost long")
    groups = spark.createDataFrame(registers.TAX_GROUPS, "tax_group string, life_years int, straight_bp int, declining_bp int")
    got = registers.fiscal_years(assets, groups).collect()
    by = {(r.asset_id, r.year): r.annual for r in got}
    assert [by[1, y] for y in range(2020, 2025)] == [125_000, 250_000, 250_000, 250_000, 125_000]
    assert [by[2, y] for y in range(2020, 2025)] == [250_000, 375_000, 187_500, 93_750, 93_750]


def test_running_balances_and_proof(spark):
    rows = [(1, k, a, b, day(0)) for k, (a, b) in enumerate([(10, 10), (5, None), (5, 20), (1, 30), (2, None)])]
    df = spark.createDataFrame(rows, "f int, n int, amount long, balance long, day date")
    assert [r.n for r in ingest.broken_balances(df, "f", "n").collect()] == [3]
    flipped = df.withColumn("balance", F.when(F.col("n") == 0, -10).when(F.col("n") == 2, -20)).filter("n < 3")
    assert ingest.direction_verdict(flipped, "f", "n").first().flip


def test_yearless_dates_roll_over(spark):
    rows = [(1, k, m, 1) for k, m in enumerate([11, 12, 1, 2])]
    got = ingest.yearless_dates(spark.createDataFrame(rows, "f int, n int, month int, mday int"), "f", "n", 2023).orderBy("n").collect()
    assert [r.day.year for r in got] == [2023, 2023, 2024, 2024]


def test_controls_and_readiness(spark):
    checks = spark.createDataFrame([(1, 1, "A", "PASS"), (1, 1, "B", "REVIEW"), (1, 2, "A", "FAIL"), (1, 3, "B", "REVIEW")], "client_id int, entity_id int, check_key string, status string")
    notes = spark.createDataFrame([(1, "B")], "entity_id int, check_key string")
    assert {r.entity_id: r.ready for r in controls.readiness(checks, notes).collect()} == {1: True, 2: False, 3: False}


COMMA = "Account,123\nName,PT X\n\nDate,Description,Amount,Side,Balance\n01/02/2024,\"Sale, first\",\"1,500.50\",CR,\"101,500.50\"\n02/02/2024,Fee,500.00,DB,\"101,000.50\"\n"
SEMI = "Tanggal;Keterangan;Debet;Kredit;Saldo\n01/02/2024;Sale, first;;1.500,50;101.500,50\n02/02/2024;Fee;500,00;;101.000,50\n"
MT940 = ":20:X\n:25:123\n:60F:C240131IDR100000,\n:61:2402010201C1500,50NTRF\n:86:Sale, first\n:61:2402020202D500,NMSC\n:86:Fee\n:62F:C240202IDR101000,50\n-"


def test_layouts_give_the_same_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(COMMA)
    (tmp_path / "b.csv").write_text(SEMI)
    files = statements.read_lines(spark, str(tmp_path))
    got = sorted((r.file[-5:], r.day, r.description, r.amount, r.balance) for r in statements.table_rows(files).collect())
    want = [(dt.date(2024, 2, 1), "Sale, first", 150_050, 10_150_050), (dt.date(2024, 2, 2), "Fee", -50_000, 10_100_050)]
    assert got == [(f, *w) for f in ("a.csv", "b.csv") for w in want]


def test_mt940(spark, tmp_path):
    (tmp_path / "c.txt").write_text(MT940)
    files = statements.read_lines(spark, str(tmp_path))
    assert [(r.account, r.day, r.amount, r.description) for r in statements.mt940_rows(files).orderBy("row_number").collect()] == [("123", dt.date(2024, 2, 1), 150_050, "Sale, first"), ("123", dt.date(2024, 2, 2), -50_000, "Fee")]
    assert tuple(statements.mt940_balances(files).first())[1:] == (10_000_000, 10_100_050)


def test_sniffing(spark):
    rows = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"PK\x03\x04x"),), (bytearray(b" <html>"),), (bytearray(b"a;b"),)], "content binary")
    assert [r.k for r in rows.select(statements.file_kind("content").alias("k")).collect()] == ["PDF", "XLSX", "MARKUP", "TEXT"]
    dates = spark.createDataFrame([("a", "13/02/2024"), ("a", "01/02/2024"), ("b", "02/25/2024"), ("c", "01/02/2024")], "file string, date_text string")
    assert {r.file: r.order for r in statements.day_month_evidence(dates).collect()} == {"a": "DMY", "b": "MDY", "c": "UNKNOWN"}


def test_stream_appends_each_row_once(spark, tmp_path):
    row = (1, 7, dt.datetime(2024, 1, 5, 10), 100, "x", None)
    for k in range(2):  # the same file again
        spark.createDataFrame([row, (2, 7, dt.datetime(2024, 1, 5, 11), k, "y", None)], landing.ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = landing.append_new(landing.statement_rows(spark, f"{tmp_path}/in"), "landed", f"{tmp_path}/check")
        q.awaitTermination()
    assert spark.table("landed").count() == 3
    spark.sql("drop table landed")


def test_settlement_candidates_match_loop(spark):
    rng = random.Random(17)
    names = ["PT Sinar Jaya", "CV Budi Karya", "Toko Makmur", "PT", "Sinar Abadi"]
    items = []
    for i in range(120):
        c = rng.randrange(5)
        issued = None if rng.random() < 0.1 else day(rng.randrange(40))
        items.append((i, c % 2, rng.choice(["IN", "OUT"]), c, names[c], f"INV/{i:03d}", rng.choice(["1130", "1131"]), issued, day(rng.randrange(40, 60)), rng.choice([-5, 0, 50, 98, 100]), rng.choice([None, 0, 2])))
    texts = [None, "TRSF sinar  jaya", "BUDI KARYA", "bayar INV-007", "MAKMUR, toko", "ABADI 1"]
    receipts = [(r, r % 2, rng.choice(["IN", "OUT"]), day(rng.randrange(40)), rng.choice([0, 48, 50, 98, 100]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "1130"]), rng.choice(texts)) for r in range(40)]
    got = receivables.settlement_candidates(
        spark.createDataFrame(receipts, "receipt_id long, entity_id int, direction string, day date, receipt long, contact_id long, account string, description string"),
        spark.createDataFrame(items, "invoice_id long, entity_id int, direction string, contact_id long, contact_name string, number string, account string, issue_date date, due_date date, open long, expected_tax long"),
    ).collect()
    norm = lambda s: re.sub("[^A-Z0-9]+", " ", (s or "").upper()).strip()
    want = {}
    for r, e, d, at, free, contact, account, text in receipts:
        found = []
        for i, e2, d2, c, name, number, account2, issued, due, opened, tax in items:
            if (e, d) != (e2, d2) or opened <= 0 or free <= 0:
                continue
            words = [w for w in norm(name).split() if len(w) >= 3 and w not in ("PT", "CV")]
            named = bool(words) and all(w in norm(text).split() for w in words) or f" {norm(number)} " in f" {norm(text)} "
            exact, same = free in (opened, opened - (tax or 0)), c == contact
            if same or ((exact or named) and (issued is None or issued <= at)):
                score = 2 if opened == free else 1 if opened > free else 0
                found.append((-same, -(exact and named), -exact, -named, -(account == account2), -score, due, i))
        want[r] = [x[-1] for x in sorted(found)]
    have = {r[0]: [] for r in receipts}
    for x in sorted(got, key=lambda x: x["rank"]):
        have[x.receipt_id].append(x.invoice_id)
    assert have == want and max(map(len, want.values())) > 3 and any(x.item_contact_id != x.contact_id for x in got)


def test_transfers_leave_third_parties_out(spark):
    entity = spark.createDataFrame([(5, "PT GEMILANG MAHAKARYA NUSA"), (6, "PT BELIFI")], "entity_id int, entity_name string")
    texts = {
        "TRSF E-BANKING DB 0108/FTSCY/WS95051 PT PURCHASE JAYA": "PT PURCHASE JAYA", "TRSF PT GEMILANG MAHAKAR": None, "TRSF KE BELIFI": None, "TRSF PT BELIFI": None, "BAYAR PT BELIFI": None,
        "TRANSFER GEMILANG": "GEMILANG", "TRSF BELIFIX": "BELIFIX", "TRSF BEL BCA": None, "TRSF BELIFI ANDI": "ANDI", "TRSF GEMILANG MAHAKARYA NUSA BELIFI SENDIRI": None, "TRSF CV BUDI": "CV BUDI", "FEE": "FEE",
    }
    lines = [(i, 1 + i % 2, 5, day(0), (-1) ** i * (100 + i), x) for i, x in enumerate(texts)]
    schema = "line_id long, bank_account int, entity_id int, day date, amount long, description string"
    got = {r.description: r for r in matching.transfer_lines(spark.createDataFrame(lines, schema), entity).collect()}
    assert {k: r.third_party for k, r in got.items()} == texts
    assert not got["FEE"].hinted and got["BAYAR PT BELIFI"].hinted
    rows = [
        (1, 1, 5, day(0), -100, "TRSF BELIFI", False, False), (2, 2, 6, day(1), 100, "BAYAR PT BELIFI", False, False), (3, 3, 5, day(0), 100, "TRSF PT PURCHASE JAYA", False, False),
        (4, 1, 5, day(0), -70, "TRSF", False, False), (5, 2, 5, day(0), 70, "TRSF", False, True), (6, 3, 5, day(0), 70, "TRSF", True, False),
        (7, 1, 5, day(0), -50, "TRSF", False, False), (8, 2, 5, day(0), 50, "TRSF", False, False), (9, 3, 6, day(1), 50, "TRSF", False, False), (10, 1, 5, day(1), -50, "TRSF", False, False),
    ]
    df = spark.createDataFrame(rows, schema + ", matched boolean, pair_refused boolean")
    pairs = matching.transfer_pairs(df, entity).collect()
    assert sorted((p.out_id, p.in_id, p.account, p.confidence_pct) for p in pairs) == [(1, 2, "1190", 99), (7, 8, "1199", 80), (7, 9, "1190", 80), (10, 8, "1199", 80), (10, 9, "1190", 80)]
    said = {r.line_id: (r.account, sorted(x.line_id for x in r.others)) for r in matching.transfer_suggestions(df, entity).collect()}
    assert said == {7: ("1199", [8, 9, 10]), 8: ("1199", [7, 9, 10]), 9: ("1190", [7, 8, 10]), 10: ("1199", [7, 8, 9])}


def test_one_to_one_matches_loop(spark):
    rng = random.Random(12)
    row = lambda i: (i, rng.randrange(3), rng.randrange(4), day(rng.randrange(12)), rng.choice([None, None, "0123456789012345", "12.345.678.901.234-5", "9"]), rng.choice([None, "PT SINAR ABADI", "sinar", "BUDI", "TRANSFER", "abadi jaya"]))
    docs, book = [row(i) for i in range(150)], [row(i) for i in range(1000, 1140)]
    docs += [(500, 9, 9, day(10), None, None)]
    book += [(1500, 9, 9, day(1), None, None), (1501, 9, 9, day(10), None, None)]
    schema = "{0}_id long, entity_id int, amount long, {0}_day date, tax_id string, text string"
    got = matching.one_to_one(spark.createDataFrame(docs, schema.format("doc")), spark.createDataFrame(book, schema.format("book"))).collect()
    digits = lambda s: re.sub(r"\D", "", s or "")[-15:]
    words = lambda s: {w for w in re.split("[^A-Z0-9]+", (s or "").upper()) if len(w) >= 4} - {"TRANSFER"}
    free, want = {b[0]: b for b in book}, set()
    for i, e, a, at, tax, text in sorted(docs, key=lambda x: (x[3], x[0])):
        score = lambda b: 2 if tax and digits(tax) == digits(b[4]) else 1 if words(text) & words(b[5]) else 0  # noqa: B023, E731
        best = min((b for b in free.values() if b[1:3] == (e, a)), key=lambda b: (-score(b), abs((b[3] - at).days), b[0]), default=None)
        want.add((i, free.pop(best[0])[0] if best else None))
    want |= {(None, b) for b in free}
    assert len(got) == len(want) and {(r.doc_id, r.book_id) for r in got} == want and (500, 1501) in want


def test_duplicate_entries_are_disjoint_and_exclude(spark):
    entries = [("a", 0, 50, "MANUAL", None, "m"), ("b", 1, 50, "MANUAL", None, "m"), ("c", 2, 50, "MANUAL", None, "m"), ("d", 9, 50, "BANK", None, "m"), ("e", 9, 50, "BANK", None, "m"), ("f", 10, 50, "MANUAL", None, "m"),
               ("g", 20, 50, "OPENING", None, "m"), ("h", 20, 50, "MANUAL", None, "m"), ("i", 30, 50, "IMPORTED", "1", "x"), ("j", 30, 50, "IMPORTED", "1", "y"), ("k", 31, 50, "IMPORTED", "1", " X"), ("l", 40, 5, "MANUAL", None, "m"), ("m", 40, 5, "MANUAL", None, "m")]
    rows = [(1, e, day(n), acc, d, c, kind, file, memo) for e, n, amount, kind, file, memo in entries for acc, d, c in (("1", amount, 0), ("2", 0, amount))]
    df = spark.createDataFrame(rows, "entity_id int, entry_id string, day date, account string, debit long, credit long, entry_kind string, import_id string, memo string")
    pairs = lambda **k: sorted((r.entry_id, r.other_id) for r in matching.duplicate_entries(df, **k).collect())
    assert pairs(materiality=10) == [("a", "b"), ("d", "f"), ("i", "k")]
    assert pairs() == [("a", "b"), ("d", "f"), ("i", "k"), ("l", "m")]
    assert pairs(since="2024-01-03") == [("a", "c"), ("d", "f"), ("i", "k"), ("l", "m")]


def test_duplicate_query_says_what_its_sql_says_of_bank_entries_and_three_of_a_kind(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from ledgerloom.plans import queries_matching
    from ledgerloom.plans.model import Books

    con = duckdb.connect()
    for t in ("nation", "customer", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    # each order three times, two days between the copies: equal cash entries, and purchases that stand in two pairs
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    copies = [orders.withColumn("o_orderkey", F.col("o_orderkey") + 10_000 * k).withColumn("o_orderdate", F.col("o_orderdate") + F.make_dt_interval(F.lit(2 * k))) for k in range(3)]
    copies[0].unionByName(copies[1]).unionByName(copies[2]).write.parquet(str(tmp_path / "copies"))
    con.execute(f"copy (select * from '{tmp_path}/copies/*.parquet') to '{tmp_path}/orders.parquet' (format parquet)").fetchall()
    for t in ("nation", "customer", "lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'").fetchall()
    want = con.execute(entry.oracle_sql()["j21_duplicate_entries"])
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall())
    got = entry.queries()["j21_duplicate_entries"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == want and any(r[1].startswith("C") for r in want)
    # the chosen ones are among them, of no bank entry, and no entry twice
    chosen = [tuple(r) for r in entry.queries()["j21_disjoint_duplicates"](spark, str(tmp_path)).select(*names).collect()]
    ids = [e for r in chosen for e in r[1:3]]
    assert set(chosen) < set(want) and len(set(ids)) == len(ids) > 0 and not any(e[0] in "CTU" for e in ids)
    # and those that a plain loop chooses
    entries, groups, loop = {}, {}, set()
    for r in queries_matching.booked_again(Books(spark, str(tmp_path))).collect():
        entries.setdefault((r.day, r.entry_id, r.entity_id, r.entry_kind), []).append((r.account, r.debit, r.credit))
    for (at, e, entity, kind), legs in sorted(entries.items()):
        groups.setdefault((entity, tuple(sorted(legs))), []).append((at, e, kind))
    for rows in groups.values():
        used = set()
        for i, (at, x, kind) in enumerate(rows):
            for later, y, other in rows[i + 1 :]:
                if not {x, y} & used and (later - at).days <= 3 and not kind == other == "BANK":
                    used |= {x, y}
                    loop.add((x, y))
    assert {r[1:3] for r in chosen} == loop


def test_proved_days_match_loop(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for account in range(60):
        n, start = rng.randrange(1, 7), rng.randrange(-50, 50)
        balance, day_rows = start, []
        for _ in range(n):
            amount = rng.choice([-7, -3, 2, 5, 9, 11])
            balance += amount
            day_rows.append([amount, balance])
        if account % 4 == 1:
            day_rows[rng.randrange(n)][1] = None
        if account % 4 == 2:
            day_rows[rng.randrange(n)][1] += 1000
        rng.shuffle(day_rows)
        # by trial: some order of the rows in which each balance leads to the next, and no balance twice
        fine = False
        if all(b is not None for _, b in day_rows):
            froms, tos = [b - a for a, b in day_rows], [b for _, b in day_rows]
            ends = [b for b in tos if b not in froms]
            if len(set(froms)) == len(set(tos)) == n and len(ends) == 1:
                fine = any(all(x[1] == y[1] - y[0] for x, y in zip(order, order[1:])) for order in itertools.permutations(day_rows))
        want[account] = (n, fine)
        rows += [(account, dt.date(2024, 1, 5), a, b) for a, b in day_rows]
    got = {r.bank_account: (r.n, r.proved) for r in posting.proved_days(spark.createDataFrame(rows, "bank_account int, day date, amount long, balance long")).collect()}
    assert got == want and {True, False} == {x[1] for x in want.values()}


def test_missing_rates_are_told_and_not_guessed(spark):
    lines = spark.createDataFrame(
        [("a", "MANUAL", 1, 20, "1100", "1997-03-05", 1000, 0), ("a", "MANUAL", 1, 20, "4100", "1997-03-05", 0, 1000), ("b", "MANUAL", 1, 21, "1100", "1998-06-05", 500, 0), ("b", "MANUAL", 1, 21, "3100", "1998-06-05", 0, 500)],
        "entry_id string, entry_kind string, client_id int, entity_id int, account string, day string, debit long, credit long",
    ).withColumn("day", F.to_date("day"))
    chart = spark.createDataFrame([("1100", "Cash", "ASSET", "CASH", "MONETARY"), ("4100", "Sales", "INCOME", "REVENUE", "PLAIN"), ("3100", "Capital", "EQUITY", "CAPITAL", "PLAIN"), ("3200", "Retained", "EQUITY", "RETAINED", "RETAINED"), ("3900", "Translation", "EQUITY", "T", "PLAIN")], "account string, account_name string, type string, fs_line string, kind string")
    entity = spark.createDataFrame([(20, "USD"), (21, "USD"), (1, "IDR")], "entity_id int, currency string")
    rates = spark.createDataFrame([("1998-06-30", "SPOT", 14900)], "day string, kind string, rate long").select(F.to_date("day").alias("rate_date"), "kind", "rate")
    got = {r.entity_id: (r.closing, r.average, r.historical, r.missing) for r in currency.entity_rates(lines, chart, entity, rates, "1998-06-30").collect()}
    assert got == {20: (14900, 14900, None, "HISTORICAL"), 21: (14900, 14900, 14900, "")}
    nets = {(r.entity_id, r.account): r.net for r in currency.translated_trial_balance(lines, chart, entity, rates, "1998-06-30").collect() if r.net}
    assert nets == {(21, "1100"): 500 * 14900, (21, "3100"): -500 * 14900}
    found = {r.entity_id: (r.balance, r.carried, r.difference, r.missing) for r in currency.revaluation(lines, chart, entity, rates, "1998-06-30").collect()}
    assert found == {20: (1000, None, None, 1), 21: (500, None, None, 1)}


def test_posting_refuses_with_a_reason(spark):
    chart = spark.createDataFrame([("1", "ASSET", "Cash"), ("2", "ASSET", "Transfer clearing"), ("4", "INCOME", "Sales")], "account string, type string, account_name string")
    schema = "entry_id string, entry_kind string, entity_id int, account string, day string, debit long, credit long, reverses_id string"
    rows = [("m", "MANUAL", 1, "1", "2024-01-05", 7, 0, None), ("m", "MANUAL", 1, "4", "2024-01-05", 0, 7, None), ("k", "BANK", 1, "1", "2024-01-06", 7, 0, None), ("k", "BANK", 1, "2", "2024-01-06", 0, 7, None)]
    rows += [("d", "MANUAL", 1, "1", "2024-01-07", 1, 0, None), ("d", "MANUAL", 1, "4", "2024-01-07", 0, 1, None), ("Rd", "MANUAL", 1, "1", "2024-01-08", 0, 1, "d"), ("Rd", "MANUAL", 1, "4", "2024-01-08", 1, 0, "d")]
    rows += [("one", "MANUAL", 2, "1", "2024-01-05", 7, 0, None), ("far", "MANUAL", 2, "9", "2024-01-05", 7, 0, None), ("far", "MANUAL", 2, "1", "2024-01-05", 0, 7, None)]
    lines = spark.createDataFrame(rows, schema).withColumn("day", F.to_date("day"))
    assert {r.entry_id: r.reason for r in posting.post_checks(lines, chart, "2024-01-05").collect()} == {"m": "LOCKED", "k": None, "d": None, "Rd": None, "one": "ONE_LINE", "far": "ACCOUNT"}
    asked = spark.createDataFrame([("m", "2024-02-01"), ("m", "2024-02-02"), ("k", "2024-02-01"), ("d", "2024-02-01"), ("x", "2024-02-01"), ("one", "2024-01-01")], "entry_id string, day string").withColumn("day", F.to_date("day"))
    made, refused = posting.reversals(lines, asked)
    assert sorted((r.entry_id, r.account, r.debit, r.credit, str(r.day), r.reverses_id) for r in made.collect()) == [("Rm", "1", 0, 7, "2024-02-01", "m"), ("Rm", "4", 7, 0, "2024-02-01", "m")]
    assert sorted((r.entry_id, r.reason) for r in refused.collect()) == [("d", "AGAIN"), ("k", "KIND"), ("m", "AGAIN"), ("one", "EARLY"), ("x", "UNKNOWN")]
    assert posting.opening_bridge(lines.filter("entity_id = 1"), chart, "2024-01-31", held=("2",)).collect() == []
    bridge = posting.opening_bridge(lines.filter("entity_id = 1 and entry_id <> 'k'"), chart, "2024-01-31", held=("2",)).collect()
    assert sorted((str(r.day), r.account, r.debit, r.credit) for r in bridge) == [("2024-01-04", "1", 0, 7), ("2024-01-04", "3200", 7, 0)]


def test_posting_drops_zero_lines_first(spark):
    chart = spark.createDataFrame([("1", "ASSET"), ("4", "INCOME")], "account string, type string")
    rows = [("a", "1", 7, 0), ("a", "4", 0, 7), ("a", "9", 0, 0), ("b", "1", 7, 0), ("b", "4", 0, 0), ("c", "1", 7, 7), ("c", "4", 0, 0), ("d", "1", -7, 0), ("d", "4", 0, -7), ("e", "1", 0, 0), ("f", "1", 7, None), ("f", "4", None, 7)]
    lines = spark.createDataFrame([(e, 1, a, day(1), d, c) for e, a, d, c in rows], "entry_id string, entity_id int, account string, day date, debit long, credit long")
    got = {r.entry_id: (r.n, r.reason) for r in posting.post_checks(lines, chart, "2023-12-31").collect()}
    assert got == {"a": (2, None), "b": (1, "ONE_LINE"), "c": (1, "SIDES"), "d": (2, "SIDES"), "e": (0, "ONE_LINE"), "f": (2, None)}
    assert sorted((r.entry_id, r.account) for r in posting.posted(lines, chart, "2023-12-31").collect()) == [("a", "1"), ("a", "4"), ("f", "1"), ("f", "4")]


def test_reversals_of_reversals_and_owned_entries(spark):
    schema = "entry_id string, entry_kind string, entity_id int, account string, day date, debit long, credit long, reverses_id string"
    lines = spark.createDataFrame([(e, "MANUAL", 1, a, day(5), d, 7 - d, r) for e, r in (("m", None), ("n", None), ("d", None), ("Rd", "d"), ("i", None), ("x", None)) for a, d in (("1", 7), ("4", 0))], schema)
    asked = spark.createDataFrame([("m", day(1)), ("m", day(8)), ("m", day(9)), ("n", day(2)), ("d", day(9)), ("Rd", day(9)), ("i", day(9)), ("x", day(9))], "entry_id string, day date")
    owned = spark.createDataFrame([("i", "ASSET"), ("i", "SCHEDULE"), ("x", "CURRENCY")], "entry_id string, owner string")
    made, refused = posting.reversals(lines, asked, owned=owned)
    assert sorted((r.entry_id, r.day) for r in made.collect()) == [("Rm", day(8))] * 2
    assert sorted((r.entry_id, r.day, r.reason) for r in refused.collect()) == [
        ("Rd", day(9), "REVERSAL"), ("d", day(9), "AGAIN"), ("i", day(9), "SCHEDULE"), ("m", day(1), "EARLY"), ("m", day(9), "AGAIN"), ("n", day(2), "EARLY"), ("x", day(9), "CURRENCY"),
    ]


def test_openings_look_at_bank_lines(spark):
    lines = spark.createDataFrame([("MANUAL", 1, day(0)), ("BANK", 1, day(20)), ("BANK", 2, day(5))], "entry_kind string, entity_id int, day date")
    typed = spark.createDataFrame([(1, "1", 9, 0), (2, "1", 9, 0), (3, "1", 9, 4), (4, "1", 0, 0)], "entity_id int, account string, debit long, credit long")
    made, heads = posting.openings(typed, lines, "2024-01-10")
    assert {r.entity_id: r.reason for r in heads.collect()} == {1: None, 2: "LATE", 3: "SIDES", 4: "EMPTY"}
    assert sorted((r.entity_id, r.account, r.debit, r.credit) for r in made.collect()) == [(1, "1", 9, 0), (1, "3290", 0, 9)]


def test_bridge_starts_before_the_first_entry_and_keeps_unknown_accounts(spark):
    chart = spark.createDataFrame([("1", "ASSET"), ("2", "LIABILITY"), ("4", "INCOME")], "account string, type string")
    rows = [(1, "1", day(0), 5, 0), (1, "2", day(0), 0, 5), (1, "1", day(3), 0, 5), (1, "2", day(3), 5, 0), (1, "1", day(9), 8, 0), (1, "4", day(9), 0, 8)]
    rows += [(2, "1", day(2), 4, 0), (2, "1999", day(2), 0, 4), (3, "1", day(2), 4, 0), (3, "7777", day(2), 0, 4), (4, "1", day(60), 1, 0), (4, "4", day(60), 0, 1)]
    lines = spark.createDataFrame(rows, "entity_id int, account string, day date, debit long, credit long")
    got = sorted((r.entity_id, r.day, r.account, r.debit, r.credit) for r in posting.opening_bridge(lines, chart, "2024-01-31").collect())
    before = dt.date(2023, 12, 31)
    assert got == [(1, before, "1", 0, 8), (1, before, "3200", 8, 0), (3, day(1), "1", 0, 4), (3, day(1), "7777", 4, 0)]


def test_receipts_start_at_the_first_bank_line(spark):
    chart = spark.createDataFrame([("4100", "INCOME", "REVENUE"), ("2100", "LIABILITY", "PAYABLES")], "account string, type string, fs_line string")
    bank = [(1, dt.date(2024, 1, 9), -5, "4100", "POSTED"), (2, dt.date(2024, 3, 9), 90, "4100", "POSTED"), (3, dt.date(2024, 3, 9), 10, "4100", "NEEDS_REVIEW"), (4, dt.date(2024, 4, 9), 50, None, "POSTED"), (5, dt.date(2024, 4, 1), 7, None, "POSTED"), (6, dt.date(2024, 4, 2), 9, "1190", "POSTED")]
    frame = spark.createDataFrame([(i, 1, *r) for i, *r in bank], "line_id long, entity_id int, day date, amount long, account string, status string")
    parts = spark.createDataFrame([(4, "2100", 20), (4, "4100", 30)], "line_id long, account string, amount long")
    lines = spark.createDataFrame([(1, "4100", dt.date(2024, 3, 5), 0, 60)], "entity_id int, account string, day date, debit long, credit long")
    got = posting.receipts_and_revenue(frame, lines, chart, 2024, 4, parts=parts).orderBy("year", "month").collect()
    assert [(r.month, r.money_in, r.transfers, r.financing, r.unclassified, r.operating, r.revenue, r.ratio) for r in got] == [
        (1, 0, 0, 0, 0, 0, 0, None), (2, 0, 0, 0, 0, 0, 0, None), (3, 100, 0, 0, 10, 90, 60, 1500), (4, 66, 9, 20, 7, 30, 0, None),
    ]


def proofs_by_loop(rows, opening, chained):
    """States and expected balances of (day, debit, credit, balance) rows, one after the other."""
    states, expected, prev, pending = [], [], opening, []
    for i, (on, debit, credit, balance) in enumerate(rows):
        debit, credit = debit or 0, credit or 0
        want = None if prev is None else prev + credit - debit
        if on is None:
            state = "BAD_DATE"
        elif min(debit, credit) < 0 or debit and credit:
            state = "BAD_AMOUNT"
        elif credit == debit:
            state = "NO_AMOUNT"
        elif prev is None:
            state = "NO_OPENING"
        else:
            state = "NO_BALANCE" if balance is None else "OK" if balance == want else "BREAK"
        states.append(state)
        expected.append(want)
        if pending and rows[pending[0]][0] != on:
            pending = []
        if state == "NO_BALANCE":
            pending.append(i)
        else:
            for j in pending if chained and state in ("OK", "BREAK") else []:
                states[j] = state
            pending = []
        prev = want if balance is None else balance
    return states, expected


def test_row_proofs_match_a_loop(spark):
    rng, all_rows, want = random.Random(11), [], {}
    for f in range(60):
        opening, balance, rows = rng.choice([None, 100, 0]), 0, []
        for k in range(rng.randrange(1, 14)):
            debit, credit = rng.choice([(5, None), (None, 7), (0, 3), (None, None), (2, 2), (-1, 0), (4, 0), (0, 9)])
            balance += (credit or 0) - (debit or 0)
            rows.append((rng.choice([day(k // 3), day(k // 3), day(k // 3), None]), debit, credit, rng.choice([None, None, balance + (opening or 0), 50])))
        all_rows += [(f, i, *r, opening) for i, r in enumerate(rows)]
        for chained in (False, True):
            want[f, chained] = proofs_by_loop(rows, opening, chained)
    df = spark.createDataFrame(all_rows, "f int, n int, day date, debit long, credit long, balance long, opening long")
    for chained in (False, True):
        got = {}
        for r in ingest.proved_rows(df, "f", "n", chained).orderBy("f", "n").collect():
            got.setdefault(r.f, []).append((r.state, r.expected))
        assert got == {f: list(zip(*want[f, chained])) for f in range(60)}
    proofs = ingest.statement_proofs(ingest.proved_rows(df, "f", "n").withColumn("closing", F.lit(None).cast("long")), "f", "n").collect()
    assert {p.f: p.problems for p in proofs} == {f: sum(s != "OK" for s in want[f, False][0]) for f in range(60)}
    assert all(p.closing_ok is None for p in proofs)


def test_references_of_rows(spark):
    cells = [(1, "S", c) for c in ("F9", "A7", "A5", "A6", "F10", "x", "A6", "F2")] + [(2, "T", "3"), (2, "T", "4")] + [(3, "U", f"A{2 * i}") for i in range(300)] + [(4, "V", "none")]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cells)], "k int, sheet string, cell string, position long")
    got = {r.k: r.reference for r in reviews.row_references(df, "k").collect()}
    assert got == {1: "S!F2,F9-10,A5-6,A6-7", 2: "T!3-4", 3: ("U!" + ",".join(f"A{2 * i}" for i in range(300)))[:500]}


def test_parts_and_flags(spark):
    part = "struct<account:string,amount:long>"
    rows = [
        (1, "x ANGSURAN POKOK", -100, "4100", "POSTED", "RULE", 99, [("4100", 60), ("2100", 40)]),
        (2, "BUNGA PINJAMAN", -5, "6200", "POSTED", "RULE", 99, None),
        (3, "MODAL", 5, "4100", "NEEDS_REVIEW", "RULE", 99, []),
        (4, "sale", 7, "4100", "REVIEWED", "AI", 59, []),
        (5, "sale", 7, "4100", "REVIEWED", "AI", 60, []),
        (6, "MODAL", 7, None, "POSTED", "HEURISTIC", 1, []),
    ]
    df = spark.createDataFrame(rows, f"line_id int, description string, amount long, account string, status string, method string, confidence_pct int, parts array<{part}>")
    df = df.selectExpr("*", "1 as client_id", "2 as entity_id", "date '2024-01-01' as day")
    chart = spark.createDataFrame([("4100", "INCOME"), ("6200", "EXPENSE"), ("2100", "LIABILITY")], "account string, type string")
    assert sorted((r.line_id, r.account, r.amount) for r in reviews.by_part(df).collect() if r.line_id < 3) == [(1, "2100", -40), (1, "4100", -60), (2, "6200", -5)]
    assert sorted((r.flag, r.line_id, r.amount) for r in reviews.flagged_lines(df, chart).collect()) == [("FINANCING", 1, -60), ("GUESS", 4, 7)]


def test_settings_and_periods(spark):
    asked = spark.createDataFrame([(1, 4), (1, 5), (1, 9), (2, 5)], "e int, month int")
    settings = spark.createDataFrame([(1, 5, 70), (1, 8, 80)], "e int, effective_month int, rate long")
    assert sorted((r.e, r.month, r.rate) for r in reviews.in_force(asked, settings, "e", "rate").collect() if r.rate) == [(1, 5, 70), (1, 9, 80)]
    d = dt.date
    lines = [(1, d(2023, 12, 31), "OPENING"), (1, d(2024, 3, 1), "BANK"), (2, d(2024, 2, 1), "OPENING"), (2, d(2024, 2, 3), "BANK"), (3, d(2023, 4, 1), "BANK"), (4, d(2024, 6, 30), "OPENING"), (5, d(2024, 5, 1), "BANK")]
    df = spark.createDataFrame([(0, *x) for x in lines], "client_id int, entity_id int, day date, entry_kind string")
    got = {r.entity_id: (r.books_start, r.from_day, r.compared_balance, r.compared_opening, r.prior_end) for r in reviews.report_periods(df, "2024-06-30").collect()}
    first = d(2024, 1, 1)
    assert got == {
        1: (first, first, d(2023, 12, 31), True, None),
        2: (d(2024, 2, 2), d(2024, 2, 2), d(2024, 2, 1), True, None),
        3: (first, first, d(2023, 12, 31), False, d(2023, 6, 30)),
        4: (d(2024, 7, 1), first, None, None, None),
        5: (first, first, None, None, None),
    }


def test_stored_journal_equals_the_derived_one(spark):
    from ledgerloom.plans.model import Books

    books = Books(spark, "/root/testdata/sf0.001")
    stored, derived = books.journal_line(), books._derived(None)
    assert stored.dtypes == derived.dtypes and stored.exceptAll(derived).isEmpty() and derived.exceptAll(stored).isEmpty()
    assert books.journal_line(("1130", "4100")).exceptAll(books._derived(("1130", "4100"))).isEmpty()
    assert Books(spark, "/root/testdata/sf0.001")._journal() == books._journal()
