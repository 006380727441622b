"""Scalar functions against plain Python, on hand-picked and random values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates as d
from ledgerloom.functions import money as m
from ledgerloom.functions import text as t


def away(n, q):
    return (1 if n >= 0 else -1) * ((2 * abs(n) + q) // (2 * q))


def test_rounding_matches_python(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-(10**15), 10**15), rng.randrange(1, 10**6)) for _ in range(300)] + [(5, 2), (-5, 2), (0, 7), (7, 2), (-7, 2)]
    rows = spark.createDataFrame(pairs, "n long, q long").select("n", "q", m.div("n", "q").alias("t"), m.div_round("n", "q").alias("r"), m.half_up(F.abs("n"), "q").alias("h")).collect()
    for r in rows:
        assert r.t == (1 if r.n >= 0 else -1) * (abs(r.n) // r.q)
        assert r.r == away(r.n, r.q) and r.h == (2 * abs(r.n) + r.q) // (2 * r.q)


@pytest.mark.parametrize(
    "text,rupiah,cents",
    [
        ("1.234.567,00", 1234567, 123456700),
        ("1,234,567.00", 1234567, 123456700),
        ("1500000.00", 1500000, 150000000),
        ("-2.500", -2500, -250000),
        ("(2.500)", -2500, -250000),
        ("Rp 1.000,50", 1001, 100050),
        ("0,5", 1, 50),
        ("12,3456", 12, 1235),
        ("", 0, 0),
        ("-", 0, 0),
        (None, 0, 0),
        ("abc", None, None),
        ("+7", 7, 700),
        ("(-3)", 3, 300),
    ],
)
def test_amount_texts(spark, text, rupiah, cents):
    row = spark.createDataFrame([(text,)], "x string").select(m.parse_rupiah("x"), m.parse_cents("x")).first()
    assert tuple(row) == (rupiah, cents)


def test_conversion_and_splits(spark):
    row = spark.range(1).select(
        m.convert_minor(F.lit(100), F.lit(1225050), F.lit(2), F.lit("USD"), F.lit("IDR")),
        m.invert_rate(F.lit(16), F.lit(0)),
        *m.split_vat(F.lit(111)),
        m.split_vat(F.lit(-111))[1],
        m.corporate_tax(F.lit(1_000_000_000), F.lit(9_600_000_000)),
        m.progressive_tax(F.lit(300_000_000)),
        m.split_equally(F.lit(100), F.lit(3), F.lit(3)),
    ).first()
    assert list(row) == [12251, 625000000, 100, 11, -11, 165_000_000, 44_000_000, 34]


def test_business_days(spark):
    rng = random.Random(2)
    days = [dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(60)) for _ in range(400)]
    pairs = [(a, a + dt.timedelta(rng.randrange(-20, 21))) for a in days]
    for r in spark.createDataFrame(pairs, "a date, b date").select("a", "b", d.business_days_apart("a", "b").alias("n")).collect():
        low, high = min(r.a, r.b), max(r.a, r.b)
        assert r.n == sum((low + dt.timedelta(k)).weekday() < 5 for k in range(1, (high - low).days + 1)), (r.a, r.b)


def test_dates(spark):
    row = spark.createDataFrame([(dt.date(2024, 2, 29),)], "x date").select(d.fiscal_year_start("x", 3), d.months_into_year("x", 3), d.due_of_month(d.month_index("x"), True), d.due_of_month(d.month_index("x"), False), d.excel_date(F.lit(45351))).first()
    assert list(row) == [dt.date(2023, 4, 1), 11, dt.date(2024, 3, 31), dt.date(2024, 3, 15), dt.date(2024, 2, 29)]
    texts = [("31/01/2024", dt.date(2024, 1, 31)), ("2024-01-31", dt.date(2024, 1, 31)), ("5 Mei 2024", dt.date(2024, 5, 5)), ("05-06-24", dt.date(2024, 6, 5)), ("31/31/2024", None), ("x", None), (None, None)]
    got = spark.createDataFrame(texts, "x string, want date").select("want", d.parse_date("x").alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_text(spark):
    row = spark.createDataFrame([("TRSF E-BANKING DB 0108/FTSCY/WS95051 15000000.00 PT PAKAN JAYA",)], "x string").select(
        t.merchant_key("x"), t.is_generic_key(F.lit("BI FAST OUTGOING")), t.is_generic_key(F.lit("PT PAKAN")), t.normal_name(F.lit("PT. Maju, Jaya Tbk")), t.tax_id(F.lit("0012.3456.7890.1234")), t.amount_marker(F.lit("1.000,00 CR"))
    ).first()
    assert list(row) == ["PT PAKAN JAYA", True, False, "MAJUJAYA", "012345678901234", "CR"]


def test_generic_keys_and_row_hashes_read_whole_texts(spark, monkeypatch):
    from hashlib import sha1

    from ledgerloom.plans import catalog, model

    catalog.load()

    d = dt.date(2024, 1, 1)
    rows = [(1, 1, d, 199, "PAYMENT 0001 PT PURCHASE JAYA"), (2, 1, d, 101, "PAYMENT 0001 PT PURCHASE JAYA"), (3, 1, d, 199, "PAYMENT 0002"), (4, 1, d, 199, "PAYMENT 0002"), (5, 2, d, 199, "PAYMENT 0002"), (6, 1, d, 199, "PAYMENT 0002")]
    lines = spark.createDataFrame(rows, "line_id long, bank_account int, day date, amount long, description string")
    monkeypatch.setattr(model.Books, "bank_line", lambda self: lines)
    generic = {r.line_id: r.generic for r in catalog.QUERIES["p2_generic_keys"](spark, "").collect()}
    assert generic == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True}
    cut = lambda s: sha1(s.encode()).hexdigest()[:24]
    base = {i: cut(f"2024-01-01|{amount}|{text}|") for i, _, _, amount, text in rows}
    got = {r.line_id: r.hash for r in catalog.QUERIES["p3_row_hashes"](spark, "").collect()}
    assert got == base | {4: cut(base[4] + "|#1"), 6: cut(base[6] + "|#2")}
