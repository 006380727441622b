"""Plans and steps that must not grow faster than their input."""

from pyspark.sql import functions as F

from ledgerloom.functions import money as m
from ledgerloom.operators import ingest as ing
from ledgerloom.operators import matching, posting, receivables
from ledgerloom.operators import repair as rp
from ledgerloom.plans.model import Books


def plan(df):
    return df._jdf.queryExecution().toString()


def test_repairs_read_later_balances_in_frames_that_only_grow(spark):
    rows = [("f", 1, 10, 10, False, 0, 30), ("f", 2, -20, 30, False, 0, 30), ("g", 1, 5, 5, False, 0, 9), ("g", 2, -4, 9, False, 0, 9), ("g", 3, 0, 9, True, 0, 9)]
    df = spark.createDataFrame(rows, "file string, n int, amount long, balance long, balance_only boolean, opening long, closing long")
    found = rp.repaired_rows(df, "file", "n")
    assert "unboundedfollowing" not in plan(found)
    assert sorted((r["file"], r["n"], r["note"]) for r in found.collect()) == [("f", 1, None), ("f", 2, "FLIP_UNPROVED"), ("g", 1, None), ("g", 2, "FLIP_UNPROVED")]


def test_later_balances_come_from_a_frame_that_only_grows(spark):
    rows = [("a", n, 1 if n in (3, 6) else None) for n in range(1, 9)]
    found = ing.later_balances(spark.createDataFrame(rows, "k string, n int, balance long"), "k", "n")
    assert "unboundedfollowing" not in plan(found)
    assert [r["confirmed"] for r in found.orderBy("n").collect()] == [True] * 5 + [False] * 3


def test_chained_proofs_come_from_a_frame_that_only_grows(spark):
    rows = [("a", 1, "2024-01-01", 0, 5, None, 0), ("a", 2, "2024-01-01", 0, 5, 10, 0), ("a", 3, "2024-01-01", 0, 1, None, 0), ("a", 4, "2024-01-02", 0, 1, 13, 0), ("a", 5, "2024-01-02", 0, 1, None, 0)]
    df = spark.createDataFrame(rows, "k string, n int, d string, debit long, credit long, balance long, opening long").withColumn("day", F.to_date("d"))
    found = ing.proved_rows(df, "k", "n", chained=True)
    assert "unboundedfollowing" not in plan(found)
    assert [r["state"] for r in found.orderBy("n").collect()] == ["OK", "OK", "NO_BALANCE", "BREAK", "NO_BALANCE"]


def test_amounts_are_small_expressions(spark):
    df = spark.createDataFrame([("Rp (1.234,56)",), ("(1.234,56)",), ("1,234.5",), ("",), (None,), ("x",), ("-7",)], "x string")
    found = df.select(m.parse_rupiah("x").alias("r"), m.parse_cents("x").alias("c"))
    assert plan(found).count("regexp_replace") < 100  # names of one text by names of it grew beyond what compiles
    assert [tuple(r) for r in found.collect()] == [(-1235, -123456), (-1235, -123456), (1235, 123450), (0, 0), (0, 0), (None, None), (-7, -700)]


def test_the_stored_journal_is_a_row_an_entry_dealt_once(spark):
    b = Books(spark, "/root/testdata/sf0.001")
    path, lines = b._journal(), b.journal_line()
    rows = sum(spark.read.parquet(f"{path}/{part}").count() for part in ("heads", "sales"))
    assert rows * 3 < lines.count()
    # an entry's legs meet before the shuffle
    assert plan(b._sales(spark.read.parquet(f"{path}/heads"))).count("Exchange hashpartitioning(order_id") <= 2


def test_checks_sum_entries_before_their_one_shuffle(spark):
    lines = Books(spark, "/root/testdata/sf0.001").journal_line()
    checked = posting.post_checks(lines, spark.createDataFrame([("1100",)], "account string"), "1993-12-31")
    assert "LeftSemi" not in plan(checked) and plan(checked).split("== Physical Plan ==")[1].count("Exchange hashpartitioning(entry_id") == 1


def test_duplicates_read_their_lines_once(spark):
    rows = [(1, "a", 1, "A", 5, 0), (1, "a", 1, "B", 0, 5), (1, "b", 2, "B", 0, 5), (1, "b", 2, "A", 5, 0), (1, "c", 2, "A", 0, 5), (1, "c", 2, "B", 5, 0), (1, "d", 9, "A", 5, 0), (1, "d", 9, "B", 0, 5)]
    df = spark.createDataFrame(rows, "entity_id int, entry_id string, d int, account string, debit long, credit long").selectExpr("*", "date_add(date'2024-01-01', d) as day")
    found = matching.duplicate_entries(df)
    assert plan(found).split("== Physical Plan ==")[1].count("Scan") == 1
    assert [(r["entry_id"], r["other_id"]) for r in found.collect()] == [("a", "b")]


def test_documents_of_one_word_choose_in_near_linear_time():
    import datetime as dt
    import time

    import pandas as pd

    n, start = 30_000, dt.date(2024, 1, 1)
    side = lambda name: pd.DataFrame({"entity_id": 1, "amount": 5, f"{name}_id": range(n), f"{name}_day": [start + dt.timedelta(k * 7 % 28) for k in range(n)], "tax": None, "words": [["REKENING"]] * n})
    began = time.perf_counter()
    found = matching._choose(side("doc"), side("book"))
    assert time.perf_counter() - began < 15  # a minimum over all free rows took the square
    assert (found["doc_day"] == found["book_day"]).all() and len(found) == n


def test_an_employee_is_folded_once(spark):
    from ledgerloom.plans.queries_corrections import w12

    text = plan(w12(Books(spark, "/root/testdata/sf0.001"))).split("== Physical Plan ==")[1]
    assert 0 < text.count("aggregate(sequence(") <= 2 and "REPARTITION_BY_NUM" in text


def test_a_day_is_chained_in_linear_time():
    import datetime as dt
    import time

    import pandas as pd

    n = 30_000
    day = pd.DataFrame({"bank_account": 1, "day": dt.date(2024, 1, 1), "amount": 2, "balance": range(2, 2 * n + 2, 2)})
    began = time.perf_counter()
    found = posting._chain(day).iloc[0]
    assert time.perf_counter() - began < 5  # the set of balances was built anew for each row
    assert found["proved"] and found["closing"] == 2 * n


def test_assets_are_dealt_before_their_years_are_folded(spark):
    from ledgerloom.operators import registers

    assets = spark.sql("select id as asset_id, 'G1' as tax_group, 'STRAIGHT' as method, date '2024-01-15' as acquired_on, 100L as cost from range(0, 100, 1, 1)")
    groups = spark.createDataFrame([("G1", 4, 2500, 5000)], "tax_group string, life_years int, straight_bp int, declining_bp int")
    years = registers.fiscal_years(assets, groups)
    assert "RepartitionByExpression [asset_id" in years._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r)[1:] for r in years.filter("asset_id = 7").collect()) == [(2024, 12, 25, 75), (2025, 12, 25, 50), (2026, 12, 25, 25), (2027, 12, 25, 0)]


def test_references_carry_no_cells(spark):
    """What is sorted by row holds no cell, and no window sorts all rows by position."""
    from ledgerloom.operators import reviews

    rows = spark.createDataFrame([(1, "S", "x", 1), (1, "T", "A2", 2), (1, "T", "A1", 3)], "k int, sheet string, cell string, position long")
    found = reviews.row_references(rows, "k")
    assert [r.reference for r in found.collect()] == ["S!A1-2"]
    assert "first(sheet" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_with_a_word_that_no_receipt_holds_are_not_looked_up(spark):
    """By the word that all names share, each of them met every receipt."""
    contacts = spark.createDataFrame([(1, 5, ["CUSTOMER", "0005"]), (1, 6, ["CUSTOMER", "0006"]), (2, 5, ["CUSTOMER", "0005"]), (1, None, ["CUSTOMER"]), (1, 7, [])], "entity_id int, item_contact_id long, _name array<string>")
    words = spark.createDataFrame([(1, "CUSTOMER"), (1, "0005"), (1, "CUSTOMER"), (1, "0001"), (2, "CUSTOMER")], "entity_id int, word string")
    found = receivables.rarest_words(contacts, words, ["entity_id"]).collect()
    assert sorted((r["entity_id"], r["item_contact_id"] or 0, r["word"]) for r in found) == [(1, 0, "CUSTOMER"), (1, 5, "0005")]


def test_settlement_pairs_move_once_to_their_receipt(spark):
    receipts = spark.createDataFrame([(1, 1, "IN", "2024-01-05", 50, 7, None, "bayar SINAR JAYA 0123")], "receipt_id long, entity_id int, direction string, d string, receipt long, contact_id long, account string, description string")
    rows = [(10, 7, "Budi", "1"), (11, None, "PT Sinar Jaya", "2"), (12, 8, "Makmur", "0123"), (13, 8, "Makmur", "4")]
    items = spark.createDataFrame([(i, 1, "IN", c, name, number, "1130", "2024-01-01", 70, 0) for i, c, name, number in rows], "invoice_id long, entity_id int, direction string, contact_id long, contact_name string, number string, account string, d string, open long, expected_tax long")
    found = receivables.settlement_candidates(receipts.withColumn("day", F.to_date("d")), items.withColumn("issue_date", F.to_date("d")).withColumn("due_date", F.to_date("d")))
    assert plan(found).split("== Physical Plan ==")[1].count("Exchange hashpartitioning(receipt_id") == 1
    # a contact that is null is named like any other
    assert [(r["invoice_id"], r["same_contact"], r["named"]) for r in found.orderBy("rank").collect()] == [(10, True, False), (11, False, True), (12, False, True)]
